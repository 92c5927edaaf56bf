"""Helpers that the operators share: written stages, row keys, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from ..operators.stages import shared_dir, stage

__all__ = ["bounded_batches", "components", "keyed", "lean", "shared_dir", "slices", "stage", "unused"]


#: Bytes of texts that a batch to Python has at most, about.
BATCH = "4m"


def bounded_batches(rows: DataFrame) -> DataFrame:
    """rows, whose session from now on sends whole texts to Python in small batches, unless it was given a size itself: by default two tasks would hold some 64 MB a batch, in the JVM and in Python."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", rows.sparkSession.conf
    if conf.get(name, BATCH) == BATCH:
        conf.set(name, BATCH)
    return rows


def lean(f: Callable) -> Callable:
    """f, a function of Arrow batches. When it ends, its worker gives free memory back to the system: workers outlive their tasks, and what all stages left would add up."""

    @wraps(f)
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from f(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return freed


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with about `most` bytes in a column at a time, and at most 10,000 of them; a larger row comes alone. Nothing of no rows."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) + most // 10_000 + 1)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def unused(df: DataFrame, name: str) -> str:
    """name, or name with marks after it, that is no column of df in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, text) with a unique, non-null long key that rises with (id, text), nulls last.

    Ids that are unique, whole numbers and never null are the key themselves; this is checked on the id column alone.
    Otherwise the rows are sorted once, numbered and written, so that the numbers can't change when a task runs again.
    """
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = dict(rows.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint")
    clash = rows.groupBy("id").count().where("count > 1 or id is null").limit(1) if whole else None
    if clash is not None and clash.isEmpty():
        return rows.select(F.col("id").cast("long").alias("key"), "id", "text")
    return stage(rows.orderBy(F.col("id").asc_nulls_last(), "text").select(F.monotonically_increasing_id().alias("key"), "id", "text"), "keyed")
