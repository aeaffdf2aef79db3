"""A folder for intermediate tables that driver and executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; where none is set, a temporary folder serves a local master, and a cluster is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="tensorloom-")
