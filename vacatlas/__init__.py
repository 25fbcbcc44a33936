"""Vacatlas: job-posting analytics as Spark DataFrame jobs."""

from __future__ import annotations


def ship(spark) -> str:
    """Send this library to the Python workers of a running session, wherever it was started from.

    Only needed where the workers have not installed it.  Returns the archive's path.
    """
    import os
    import tempfile
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="vacatlas-"), "vacatlas.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    archive.write(whole, os.path.join("vacatlas", os.path.relpath(whole, root)))
    spark.sparkContext.addPyFile(path)  # Spark copies it to every executor
    return path
