"""Where written tables go: the shared folder of the session, and the curated tables of a field."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset and all of Spark is in one process, a temporary one is set."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset; set it to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="brinework-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        there = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", there)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as a Parquet table in the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
