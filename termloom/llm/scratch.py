"""Durable intermediate tables, as the rest of the library keeps them, and the session's Arrow batches."""

from pyspark.sql import DataFrame, SparkSession

from ..durable import Scratch as Tables
from ..durable import shared_folder

__all__ = ["Scratch", "shared_folder"]

_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows, and bytes, of whole texts sent to a Python worker at once: the defaults of 10,000 rows and 64 MB are held several
#: times over, in the executor's direct memory and in the worker.
RECORDS, BYTES = 1000, 8 << 20


class Scratch(Tables):
    """Where the session's Arrow batches are larger, they are set to RECORDS rows and BYTES bytes for the session: results
    are computed after the call, so the setting cannot be taken back with its end.

    The files of the exchanges that make a table go once it is written; else they stay until the driver happens to collect
    its garbage, and several steps' exchanges lie on the disks together."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        super().__init__(spark, name)
        if not 0 < int(spark.conf.get(_BATCH)) <= RECORDS:
            spark.conf.set(_BATCH, RECORDS)
        spark.conf.set(_BYTES, BYTES)

    def save(self, df: DataFrame) -> DataFrame:
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            return super().save(df)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEAN)
            else:
                self.spark.conf.set(_CLEAN, before)

    def clear(self) -> None:
        """Delete all tables; nothing may read them any more."""
        self._delete(self.root)
