"""Sharding by sampled splitters into ranges of near equal bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

#: One range for about so many bytes of text, within these bounds; the splitters are the only thing sent to every task.
RANGE_BYTES, FEWEST, MOST = 4 << 20, 64, 1 << 16


def range_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", samples_per_range: int = 32, whole: float = 0.02) -> DataFrame:
    """(id, size, text_crc32, shard, slot): contiguous ranges of (md5 of text, id), near equal in bytes.

    Records are weighed by their size (UTF-8 bytes of the text plus 1). A sample drawn with probability in proportion to
    size gives quantile splitters; the exact weight of each range is then counted, and a range that holds over twice its
    share is split again, at sampled keys or else in the middle of its keys, until none does or all its keys are equal. Each record's
    place in bytes is its range's start plus a running sum inside the range; the place decides the shard. Then equal texts that a boundary
    parts go whole to the shard that holds their middle, if they are at most `whole` of a shard's bytes; a larger group stays parted. So sizes of shards
    differ by less than two records or `whole` of a shard.

    Null text counts as empty in size 1 with the checksum of nothing. Ids of any type will do; null ids sort first. Rows equal in id and text are ordered arbitrarily
    among themselves, which changes no value returned as a whole. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole_number = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    order = F.col(id_col).cast("long") if whole_number else F.xxhash64(id_col)
    slim = stage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            # 60 bits of the digest as a number, in the digest's order
            F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("long").alias("k1"),
            F.md5(F.encode(text, "UTF-8")).alias("digest"),
            # null ids get numbers of their own, so that many of one text can be parted
            F.when(F.col(id_col).isNull(), F.monotonically_increasing_id() - F.lit((1 << 63) - 1) - 1).otherwise(order).alias("k2"),
        ),
        "shard-keys",
    )
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = int(min(MOST, max(FEWEST, total // RANGE_BYTES)))
    splits = _sampled(slim, total, ranges, samples_per_range)
    while True:
        ranged = slim.withColumn("r", _range_of(splits)("k1", "k2"))
        held = ranged.groupBy("r").agg(F.sum("size").alias("w"), F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi"))
        over = held.where((F.col("w") > 2.0 * total / ranges) & (F.col("lo") < F.col("hi"))).collect()
        if not over:
            break
        weight = sum(x.w for x in over)
        more = _sampled(ranged.where(F.col("r").isin([x.r for x in over])), weight, max(2, int(2 * weight * ranges / total)), samples_per_range)
        middle = [(x.lo.k1 + (x.hi.k1 - x.lo.k1 + 1) // 2, -(1 << 63)) if x.lo.k1 < x.hi.k1 else (x.lo.k1, x.lo.k2 + (x.hi.k2 - x.lo.k2 + 1) // 2) for x in over]
        splits = np.unique(np.concatenate([splits, more, np.array(middle, np.int64)]), axis=0)
    ranged = slim.withColumn("r", _range_of(splits)("k1", "k2"))
    starts = ranged.groupBy("r").agg(F.sum("size").alias("w")).withColumn("start", F.sum("w").over(Window.orderBy("r")) - F.col("w")).select("r", "start")
    inside = Window.partitionBy("r").orderBy("k1", "digest", "k2", "size")
    before = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = ranged.join(F.broadcast(starts), "r").withColumn("at", F.col("start") + before)
    share = F.expr(f"cast((at * {shards}L) div {max(total, 1)}L as int)")
    sharded = stage(placed.withColumn("shard", F.least(F.lit(shards - 1), share)), "sharded")
    # of each boundary the text that it parts, if any: at most shards - 1 of them, each with its first place and its bytes
    parted = sharded.groupBy("digest").agg(F.min("at").alias("at"), F.sum("size").alias("bytes"), F.min("shard").alias("s0"), F.max("shard").alias("s1")).where("s0 < s1")
    to = F.col("shard")
    for g in parted.where(F.col("bytes") * shards <= F.lit(whole * total)).collect():
        to = F.when(F.col("digest") == g["digest"], F.lit(min(shards - 1, (g["at"] + g["bytes"] // 2) * shards // total))).otherwise(to)
    sharded = sharded.withColumn("shard", to.cast("int"))
    # slots: rows of a shard in this range before the row, plus the shard's rows in earlier ranges
    counts = sharded.groupBy("shard", "r").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("r")) - F.col("n")).select("shard", "r", "base")
    numbered = sharded.withColumn("i", F.row_number().over(Window.partitionBy("r", "shard").orderBy("at", "k2")) - 1)
    return numbered.join(F.broadcast(base), ["shard", "r"]).select("id", "size", "text_crc32", "shard", (F.col("base") + F.col("i")).cast("long").alias("slot"))


def _sampled(slim: DataFrame, total: int, ranges: int, per_range: int) -> np.ndarray:
    """Quantiles of keys drawn in proportion to size: an (n, 2) array of at most ranges - 1 rows."""
    if not total:
        return np.zeros((0, 2), np.int64)
    chance = F.col("size") * F.lit(float(ranges * per_range) / total)
    drawn = slim.where((F.pmod(F.xxhash64("k2", "k1", "size"), F.lit(1 << 30)) / float(1 << 30)) < chance)
    got = drawn.select("k1", "k2", (F.greatest(F.lit(1.0), chance)).alias("w")).toPandas().sort_values(["k1", "k2"])
    if got.empty:
        return np.zeros((0, 2), np.int64)
    at = np.searchsorted(np.cumsum(got["w"].to_numpy()), np.arange(1, ranges) * got["w"].sum() / ranges)
    return np.unique(got[["k1", "k2"]].to_numpy(np.int64)[np.minimum(at, len(got) - 1)], axis=0)


def _range_of(splits: np.ndarray):
    """How many splitters are at or below a key."""
    first, second = splits[:, 0].copy(), splits[:, 1].copy()

    @F.pandas_udf("int")
    def range_of(k1: pd.Series, k2: pd.Series) -> pd.Series:
        a, b = k1.to_numpy(np.int64), k2.to_numpy(np.int64)
        out, end = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
        for i in np.flatnonzero(end > out):
            out[i] += np.searchsorted(second[out[i] : end[i]], b[i], "right")
        return pd.Series(out.astype(np.int32))

    return range_of
