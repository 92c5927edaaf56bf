"""Keys of rows: what joins go by, whatever a table's ids are."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .stages import stage


def unused(rows: DataFrame, name: str) -> str:
    """name, or name with marks after it, that is no column of rows in any case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(rows: DataFrame, id_col: str, *then: str) -> tuple[DataFrame, str]:
    """(rows with a unique, non-null long key, its name): the id itself where it is a whole number, unique and never null, which the id column alone tells; else rows are sorted by id and the columns after it, nulls last,
    numbered and written, so that numbers are the same when a task runs again."""
    key = unused(rows, "row_key")
    if dict(rows.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") and rows.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).isEmpty():
        return rows.withColumn(key, F.col(id_col).cast("long")), key
    return stage(rows.orderBy(*(F.col(c).asc_nulls_last() for c in (id_col, *then))).withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def met(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with other by sorting both, at any size. Spark takes a written table for as small as its files are, and would tell the driver wide rows that compress well, such as vectors of zeros, whole."""
    return rows.join(other.hint("merge"), on, how)


def bounded_batches(rows: DataFrame, most: str = "4m") -> DataFrame:
    """rows, whose session from now on sends whole texts to Python a few MB at a time, unless it was given a size itself."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", rows.sparkSession.conf
    if conf.get(name, most) == most:
        conf.set(name, most)
    return rows
