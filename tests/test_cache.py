"""Caches by content, and the groups and training that use them."""

import os
import shutil

from pyspark.sql import functions as F

from riskloom.operators import dedup
from riskloom.operators.cache import ContentCache


def test_only_what_is_missing_is_worked_out(spark, tmp_path):
    cache = ContentCache(spark, str(tmp_path / "c"), "v1")
    work = lambda rows: rows.select("key", (F.length("key") * 2).alias("twice"))
    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    shown = lambda df: sorted(map(tuple, df.collect()))
    assert shown(cache.get(rows("a", "bb", "bb", None), work)) == [("a", 2), ("bb", 4)] and cache.computed == 2
    assert shown(cache.get(rows("bb", "ccc"), work)) == [("bb", 4), ("ccc", 6)] and cache.computed == 1
    assert shown(cache.get(rows("a", "bb", "ccc"), work)) == [("a", 2), ("bb", 4), ("ccc", 6)] and cache.computed == 0
    assert shown(cache.get(rows(), work)) == []
    assert ContentCache(spark, str(tmp_path / "c"), "v2").rows() is None


def test_batches_that_were_not_finished_do_not_count(spark, tmp_path):
    cache = ContentCache(spark, str(tmp_path / "c"), "v")
    rows = spark.createDataFrame([("a",)], "key string")
    cache.get(rows, lambda x: x)
    (batch,) = os.listdir(tmp_path / "c" / "v")
    shutil.copytree(tmp_path / "c" / "v" / batch, tmp_path / "c" / "v" / "batch-half", ignore=shutil.ignore_patterns("_SUCCESS"))
    assert len(cache._batches()) == 1
    shutil.copytree(tmp_path / "c" / "v" / batch, tmp_path / "c" / "v" / "batch-twice")
    assert cache.rows().count() == 1


def test_groups_of_a_grown_table_use_the_cache(spark, documents_sf001, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(documents_sf001[:60])]
    table = spark.createDataFrame(rows, "id long, text string, lang string")
    cache = ContentCache(spark, str(tmp_path / "s"), dedup.SIGNATURE_VERSION)
    dedup.near_groups(table.where("id < 40"), "id", "text", "lang", cache=cache)
    first = cache.computed
    got = dedup.near_groups(table, "id", "text", "lang", cache=cache)
    assert 0 < cache.computed <= 20 and first + cache.computed == len(set(documents_sf001[:60]))
    shown = lambda df: sorted(map(tuple, df.collect()))
    assert shown(got) == shown(dedup.near_groups(table, "id", "text", "lang"))


def test_groups_keep_odd_rows(spark):
    base = "".join(chr(97 + (i * i + 3 * i) % 26) + str(i) for i in range(400))
    rows = [(1, base, "a"), (1, base + "zz", "a"), (None, base, None), (2, None, "a"), (2, "", "b"), (None, "other text", "a")]
    got = dedup.near_groups(spark.createDataFrame(rows, "id long, text string, lang string"), "id", "text", "lang").collect()
    assert sorted((str(r.id), r.group_id) for r in got) == [("1", 0), ("1", 0), ("2", 1), ("2", 1), ("None", 0), ("None", 2)]
    assert dedup.near_groups(spark.createDataFrame([], "id long, text string, lang string"), "id", "text", "lang").count() == 0
