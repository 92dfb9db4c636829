"""Shared scratch space: the folder named by ``spark.checkpoint.dir``; a local one only under a local master."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


def base_dir(spark: SparkSession) -> str:
    """Folder all executors see. Raises if none is named and the master is not local."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if named:
        return named
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="run-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: runs the plan now and survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base_dir(spark))
    return df.checkpoint()


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{base_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
