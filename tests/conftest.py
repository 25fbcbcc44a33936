import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# started before the test modules are read, because they hold column constants
SESSION = (SparkSession.builder.master("local[4]").appName("vacatlas-tests")
           .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
           .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate())
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()
