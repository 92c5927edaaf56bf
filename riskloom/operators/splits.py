"""Splits and folds by the order of digests, and standard scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .dedup import dense


def order_key(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns), F.lit(str(seed))))


def group_split(rows: DataFrame, group_col: str, seed: int = 42) -> DataFrame:
    """rows with split: 40 % of the groups train, 30 % val, 30 % test; no group is in two. Test and val sizes round up."""
    groups = dense(rows.select(group_col).distinct().withColumn("_o", F.concat(order_key(seed, group_col), F.lit("|"), F.col(group_col).cast("string"))), "_o", "_n")
    total = groups.count()
    rest = -(-total * 6 // 10)
    test = -(-rest * 5 // 10)
    split = F.when(F.col("_n") < total - rest, "train").when(F.col("_n") < total - test, "val").otherwise("test")
    return rows.join(groups.select(group_col, split.alias("split")), group_col)


def _place(rows: DataFrame, class_col: str, id_col: str, seed: int) -> DataFrame:
    """rows with the place (from 0) in their class's digest order; a class is numbered in 256 parallel parts."""
    keyed = rows.withColumn("_o", order_key(seed, id_col)).withColumn("_part", F.substring("_o", 1, 2))
    sizes = keyed.groupBy(class_col, "_part").agg(F.count("*").alias("n"))
    bases = sizes.withColumn("_base", F.sum("n").over(Window.partitionBy(class_col).orderBy("_part")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy(class_col, "_part").orderBy("_o", id_col)) - 1
    return keyed.withColumn("_i", inside).join(F.broadcast(bases), [class_col, "_part"]).withColumn("_place", F.col("_base") + F.col("_i")).drop("_o", "_part", "_base", "_i")


def stratified_folds(rows: DataFrame, class_col: str, id_col: str, folds: int = 5, seed: int = 42, place_col: str | None = None) -> DataFrame:
    """rows with fold, and with the place in their class's digest order where a column is named for it."""
    placed = _place(rows, class_col, id_col, seed).withColumn("fold", (F.col("_place") % folds).cast("int"))
    return placed.withColumnRenamed("_place", place_col) if place_col else placed.drop("_place")


def early_stop(rows: DataFrame, class_col: str, id_col: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with is_validation for the last `share` of each class."""
    sizes = rows.groupBy(class_col).agg(F.count("*").alias("_size"))
    placed = _place(rows, class_col, id_col, seed).join(F.broadcast(sizes), class_col)
    return placed.withColumn("is_validation", F.col("_place") >= F.col("_size") - F.ceil(F.col("_size") * share)).drop("_place", "_size")


def scaled(rows: DataFrame, fit_on: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as distances from the mean of fit_on in its population standard deviations; a constant column is only centred."""
    stats = fit_on.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    out = {c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns}
    return rows.withColumns(out)
