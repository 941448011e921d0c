"""The folder that the driver and all executors see: spark.checkpoint.dir of the session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset (tests, one machine) a temporary folder of this machine, which is then set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def mounted(path: str) -> str:
    """The path as Python opens it; the codec needs a folder that is mounted everywhere."""
    scheme, _, rest = path.rpartition(":") if path.startswith("file:") else ("", "", path)
    if "://" in rest:
        raise ValueError(f"{path} is not a mounted folder")
    return ("/" + rest.lstrip("/")) if scheme else rest
