"""Durable intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset (tests on one machine), a temporary folder."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set(_SETTING, found)
    return found


class Scratch:
    """Tables under one folder of the shared store. A written table cuts lineage, survives lost executors,
    and has a known size, from which the planner decides on broadcasts."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._next = 0
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._next}"
        self._next += 1
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        out._written_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        if path := df.__dict__.pop("_written_path", None):
            self._delete(path)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None:
            return
        try:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: the cluster's own clean-up of the folder remains
            return
