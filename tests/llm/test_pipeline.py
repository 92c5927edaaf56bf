"""The pipeline's stages against plain versions."""

import random
from collections import Counter

import pytest
from test_pairs import plain_groups
from test_texts import plain_repeats

import corpus_pipeline as pipeline


def test_stages_are_named_and_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_copies", "repeats", "packing"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(0)
    word = lambda: rng.choice("bcdfg") + rng.choice("aeiou") + str(rng.randrange(90))
    rows = []
    for i in range(50):
        base = " ".join(word() for _ in range(rng.randrange(4, 120)))
        rows += [base] * rng.choice((1, 1, 2)) + [base + " end"] * (i % 7 == 0)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(rows)] + [(900, None, "en", "s", None), (901, "", "en", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_one_of_each_group_stays(spark, docs):
    got = pipeline.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    want = {i for i, _, c in plain_groups([(r.doc_id, r.text) for r in docs.collect()]) if i == c}
    assert {r.doc_id for r in got.collect()} == want


def test_texts_lose_their_repeats(spark, docs):
    got = pipeline.without_repeats(spark, docs, "")
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {}
    for i, _, spans, kept in plain_repeats([(i, t) for i, t in texts.items()]):
        if not spans:
            want[i] = (texts[i], None if texts[i] is None else len(texts[i]))
        elif kept:
            want[i] = (kept.decode("utf-8", "ignore"), len(kept.decode("utf-8", "ignore")))
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == want


def test_cut_characters_go(spark):
    said = "é" * 60 + "".join(map(str, range(60)))
    rows = spark.createDataFrame([(1, "à" + said, "en", "s", 1), (2, "è" + said, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in pipeline.without_repeats(spark, rows, "").collect()}
    # of the second text's first character the byte that the first text shares is cut, too
    kept = {i: k.decode("utf-8", "ignore") for i, _, _, k in plain_repeats([(1, "à" + said), (2, "è" + said)])}
    assert got == {i: t for i, t in kept.items() if t}


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rng = random.Random(5)
    said = [" ".join("w" + str(rng.randrange(10**6)) for _ in range(40)) for _ in range(6)]
    texts = [(1, said[0]), (1, said[0] + " end"), (1, said[1]), (2, said[1] + " end"), (None, said[2]), (None, said[2] + " end"), (None, said[3]), (None, said[4] + said[0][:150]), (3, said[5])]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    ranked = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    keyed = [(k, t) for k, (_, t) in enumerate(ranked)]
    want = Counter(ranked[k] for k, _, c in plain_groups(keyed) if k == c)
    assert Counter((r.doc_id, r.text) for r in pipeline.one_of_each_group(spark, rows, "").collect()) == want
    want = Counter((ranked[k][0], kept.decode()) for k, _, _, kept in plain_repeats(keyed) if kept)
    assert Counter((r.doc_id, r.text) for r in pipeline.without_repeats(spark, rows, "").collect()) == want


def test_columns_of_any_name_come_through(spark, sf001):
    rng = random.Random(6)
    said = [" ".join("w" + str(rng.randrange(10**6)) for _ in range(40)) for _ in range(5)]
    texts = [said[0], said[0] + " end", said[1], said[0][:200] + said[2], None, "", said[3]]
    names = ["id", "rest", "first", "n_removed", "kept", "key", "_key", "told", "text_", "component_id"]
    rows = spark.createDataFrame([(i, t, *(f"{c} {i}" for c in names)) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    for step in (pipeline.good_documents, pipeline.one_of_each_group, pipeline.without_repeats):
        got = step(spark, rows, sf001)
        assert got.columns == rows.columns
        assert all(r[c] == f"{c} {r.doc_id}" for r in got.collect() for c in names)
    assert {r.doc_id for r in pipeline.one_of_each_group(spark, rows, "").collect()} == {0, 2, 3, 4, 5, 6}
    assert {r.doc_id: r.text for r in pipeline.without_repeats(spark, rows, "").collect()}[3].endswith(said[2])
    assert {"doc_id", "piece", "ids"} <= set(pipeline.packed(spark, rows, "").columns)


def test_genuine_replacement_characters_stay(spark):
    said = "".join(map(str, range(60)))
    # the last byte of both characters is the same, so that it goes with what follows
    rows = spark.createDataFrame([(1, "\ufffd mine à" + said), (2, "\ufffd yours Р" + said + "\ufffd")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pipeline.without_repeats(spark, rows, "").collect()}
    assert got == {1: "\ufffd mine à" + said, 2: "\ufffd yours \ufffd"}


def test_stages_of_no_rows(spark, sf001):
    none = spark.read.parquet(f"{sf001}/documents.parquet").limit(0)
    for _, step in pipeline.STAGES:
        assert step(spark, none, sf001).count() == 0


def test_whole_run(spark, sf001):
    got = pipeline.run(spark, sf001).collect()
    assert {"doc_id", "piece", "ids", "sequence_id", "offset"} <= set(got[0].asDict())
    ends = Counter()
    for r in got:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf001}/labels.parquet").collect()}
    kept = {r.doc_id for r in got}
    good = [i for i, x in labels.items() if x == (1, 0)]
    assert sum(i in kept for i in good) >= 0.8 * len(good) - 12  # near copies of good texts go as well


def test_the_classifier_alone_keeps_good_texts(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    got = pipeline.good_documents(spark, docs, sf001)
    assert got.columns == docs.columns
    kept = {r.doc_id for r in got.collect()}
    labels = spark.read.parquet(f"{sf001}/labels.parquet").collect()
    good = [r.doc_id for r in labels if (r.quality, r.toxic) == (1, 0)]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
