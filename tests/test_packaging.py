"""Workers find the library from any folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
import vacatlas
vacatlas.ship(spark)

def batches(it):
    from vacatlas.functions.terms import canonical
    import pyarrow as pa
    for b in it:
        yield pa.RecordBatch.from_arrays([pa.array([canonical(x) for x in b.column(0).to_pylist()])], ["t"])

print("got", spark.createDataFrame([("CI/CD",)], "t string").mapInArrow(batches, "t string").first()[0])
"""


def test_workers_get_the_library_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "got ci cd" in done.stdout, done.stderr[-2000:]
