"""Arrow helper: a function over columns of one record batch at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Bytes of a piece of a batch: what a Python worker holds decoded at a time, beside one text.
PIECE = 4 << 20


def tidy() -> None:
    """Gives back what the task has freed, so that an idle worker keeps little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about PIECE bytes, a row at least; their rows and order are the same."""
    for batch in batches:
        rows = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    tidy()


def map_columns(df: DataFrame, keep: list, read, make: Callable[..., dict[str, list]], added: str) -> DataFrame:
    """Keep the columns ``keep`` as they are and add those of the DDL string ``added``, which ``make(values)`` returns
    as lists, ``values`` being the Arrow array of the column ``read`` (which is not returned).

    Nothing else of the row is read. Batches come a piece at a time, so memory is bounded by a piece and one text.
    """
    picked = df.select(*keep, read.alias("_read") if not isinstance(read, str) else F.col(read).alias("_read"))
    kept = picked.schema.fields[:-1]
    extra = StructType.fromDDL(added)
    schema = StructType([*kept, *extra.fields])
    order = [f.name for f in extra.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        n = len(kept)
        for batch in pieces(batches):
            made = make(batch.column(n))
            arrays = [batch.column(i).cast(wanted.field(i).type) for i in range(n)]
            arrays += [_array(made[name], wanted.field(n + i).type) for i, name in enumerate(order)]
            yield pa.RecordBatch.from_arrays(arrays, schema=wanted)

    return picked.mapInArrow(run, schema)


def _array(values, kind) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def size_of(df: DataFrame) -> int:
    """The planner's estimate of a table's bytes, from its files; it costs no job. An unknown size counts as 16 GB."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 1 << 34


#: A key with this share of all rows is hot.
HOT = 1000


def join_spread(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, whose ``key`` is unique and whose ``weight`` says how many rows of ``left`` it has,
    of ``total`` in all. Keys with more than one row in HOT travel to all tasks: there are at most HOT of them. So none of
    the other keys brings more than one row in HOT into a task. ``right`` should be a written table: it is read twice.
    """
    hot = F.broadcast(right.where(F.col(weight) * HOT > total))
    light = right.where(F.col(weight) * HOT <= total)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(light, key))


def text_of(name: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit("")).alias(name)
