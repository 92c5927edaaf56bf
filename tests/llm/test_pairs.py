"""Joins and searches against plain versions, and their edge cases."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from riskloom.llm import cover_tree, ngram_join, prefix_forest
from riskloom.llm.common import keyed

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_groups(rows):
    sets, root = [shingle_set(t) for _, t in rows], {i: i for i, _ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy[: rng.randrange(max(1, len(copy) * 9 // 10), len(copy) + 1)])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_groups_are_the_plain_ones(spark, seed):
    extra = [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "ONE  two"), (905, "two one"), (906, "x" * 50000)]
    rows = corpus(seed) + extra
    got = ngram_join.jaccard_groups(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string"))
    assert sorted(map(tuple, got.collect())) == plain_groups(rows)


def test_jaccard_groups_of_repeated_null_and_no_rows(spark):
    text = " ".join(map(str, range(30)))
    rows = spark.createDataFrame([(5, text), (5, text), (None, text), (7, "a")], "doc_id long, text string")
    assert sorted(ngram_join.jaccard_groups(rows).collect(), key=str) == sorted([(5, 26, 5), (5, 26, 5), (None, 26, 5), (7, 1, 7)], key=str)
    assert ngram_join.jaccard_groups(rows.limit(0)).count() == 0


def test_parities_never_overstate_differences():
    rng = np.random.default_rng(0)
    for n, m, both in ((900, 1100, 600), (10, 12, 9), (5000, 4000, 3900)):
        s = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        a, b = s[:n], np.concatenate([s[:both], s[n : n + m - both]])
        assert ngram_join.apart(ngram_join.parity(a), ngram_join.parity(b)) <= n + m - 2 * both


def test_shingle_names_follow_words_alone():
    one, two, three = ngram_join.shingle_sets([b"A b\tc  d e f", b"a B c d\ne f\x0b", b"a b c d e \xc3\xa9"], 5)
    assert (one == two).all()
    assert len(set(one) & set(three)) == 1


def plain_links(rows, threshold=0.93):
    able = {i: np.array(v, float) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    label = {i: lab for i, _, lab in rows}
    link = {i: set() for i, _, _ in rows}
    for i, v in able.items():
        for j, w in able.items():
            if i != j and label[i] == label[j] and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= threshold:
                link[i].add(j)
    out = []
    for i in link:
        seen, todo = {i}, [i]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((i, len(link[i]), min(seen), i == min(seen)))
    return sorted(out)


def test_cover_tree_links_are_the_plain_ones(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((6, 8))
    rows = [(i, (centers[i % 6] + rng.standard_normal(8) * (0.05 + 0.4 * (i % 5 == 0))).tolist(), i % 2) for i in range(160)]
    rows += [(500, rows[0][1], 0), (501, None, 0), (502, [0.0] * 8, 0), (503, [float("nan")] * 8, 1), (504, rows[0][1], None), (505, [1.0, None], 1), (506, [1.0, 2.0], 0), (507, (np.array(rows[0][1]) * 1e-30).tolist(), 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, links string")
    assert sorted(map(tuple, cover_tree.near_groups(table).collect())) == plain_links(rows)


def test_cover_tree_cells_and_visitors(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 30)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(4)).tolist(), i % 2) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, cover_tree.near_groups(table).collect())) == plain_links(rows)
    assert cover_tree.near_groups(table.limit(0)).count() == 0


def test_cover_tree_nodes_taken_whole_and_overfull(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 20)
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((3, 16))
    rows = [(i, (centers[i % 3] + 0.003 * rng.standard_normal(16)).tolist(), 1) for i in range(300)] + [(300 + i, (centers[0] + 0.25 * rng.standard_normal(16)).tolist(), 1) for i in range(80)]
    rows += [(500 + i, rows[i][1], 1) for i in range(0, 60, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, cover_tree.near_groups(table).collect())) == plain_links(rows)


def test_cover_tree_of_a_label_of_many_blocks(spark):
    rng = np.random.default_rng(9)
    n = 3 * cover_tree.BLOCK
    x = rng.standard_normal((n, 24))
    x[n - 500 :] = x[:500] + 0.05 * rng.standard_normal((500, 24))
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)})).selectExpr("vec_id", "embedding", "1 as label")
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    n_links, edges = np.zeros(n, np.int64), []
    for at in range(0, n, 2048):
        hit = unit[at : at + 2048] @ unit.T >= 0.93
        i, j = np.nonzero(hit)
        n_links[at : at + 2048] = hit.sum(1) - 1
        edges += [(a + at, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a + at < b]
    root = list(range(n))
    for a, b in edges:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    got = cover_tree.near_groups(table).toPandas().sort_values("id")
    assert (got["n_links"].to_numpy() == n_links).all()
    assert n_links.sum() >= 1000
    for i, c in enumerate(got["component_id"].tolist()):
        while root[i] != i:
            i = root[i]
        assert i == c


def test_forest_finds_the_nearest(spark, sf001):
    table = spark.read.parquet(f"{sf001}/embeddings.parquet").toPandas()
    x, ids = np.stack(table["embedding"].to_numpy()).astype(float), table["vec_id"].to_numpy()
    frame = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x, strict=True)] + [(100000, None, "x"), (100050, [0.0] * 64, "x"), (None, x[0].tolist(), "x"), (100100, [float("inf")] * 64, "x")], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in prefix_forest.nearest(frame, block_rows=64).collect():
        got.setdefault(r.query_id, []).append(r)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    hits = 0
    for q in ids[ids % 50 == 0]:
        near = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in near] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in near] == sorted((-r.score, r.vec_id) for r in near)
        at = {int(i): k for k, i in enumerate(ids)}
        for r in near:
            assert r.score == pytest.approx(unit[at[q]] @ unit[at[r.vec_id]], abs=1e-12)
        cos = unit @ unit[at[q]]
        cos[at[q]] = -9
        hits += len({r.vec_id for r in near} & set(ids[np.argsort(-cos)[:5]].tolist()))
    assert len(got) == (ids % 50 == 0).sum()
    assert hits / (5 * len(got)) >= 0.9


def test_forest_with_few_equal_and_no_rows(spark):
    frame = spark.createDataFrame([(50, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in prefix_forest.nearest(frame).collect()) == [(50, 1, 2), (50, 2, 3)]
    assert prefix_forest.nearest(frame.limit(0)).count() == 0


def test_forest_takes_huge_and_tiny_components(spark):
    frame = spark.createDataFrame([(50, [1e200, 1e200]), (1, [2e200, 2e200]), (2, [1e-200, 1e-200]), (3, [-1e200, 1e200])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in prefix_forest.nearest(frame).collect())
    assert got == [(50, 1, 1, 1.0), (50, 2, 2, 1.0), (50, 3, 3, 0.0)]


def test_forest_with_a_crowd_of_near_and_equal_rows(spark):
    rng = np.random.default_rng(8)
    center = rng.standard_normal(16)
    rows = [(i, (center + 0.01 * rng.standard_normal(16)).tolist()) for i in range(400)] + [(400 + i, center.tolist()) for i in range(300)] + [(700 + i, rng.standard_normal(16).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    got = {}
    for r in prefix_forest.nearest(frame, block_rows=32, target=64).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q in range(0, 1000, 50):
        cos = np.round(unit @ unit[q], 12)
        cos[q] = -9
        assert len(got[q]) == 5
        hits += len(set(got[q]) & set(np.lexsort((np.arange(1000), -cos))[:5].tolist()))
    assert hits >= 90
    assert all(got[q] == [i for i in range(400, 406) if i != q][:5] for q in range(400, 700, 50))


def test_prefix_lengths_at_which_trees_hold_enough():
    ordered = np.sort(np.array([[0b1011, 0b1010, 0b0001], [0b1000, 0b1001, 0b1100]], np.int64) << (prefix_forest.BITS - 4), 1)
    bits = np.array([[0b1011, 0b1001]], np.int64) << (prefix_forest.BITS - 4)
    assert [prefix_forest.ascend(ordered, bits, n)[0] for n in (2, 3, 4, 5, 6)] == [prefix_forest.BITS, 3, 3, 1, 0]
    assert (prefix_forest.enough(np.array([-1.0, 0.0, 0.5, 1.0]), 64, 0.05) == [0, 4, 7, prefix_forest.BITS]).all()


def test_keys_rise_with_ids(spark):
    rows = keyed(spark.createDataFrame([(3, "b"), (3, "a"), (None, "c"), (1, None)], "doc_id long, text string")).orderBy("key").collect()
    assert [(r.id, r.text) for r in rows] == [(1, ""), (3, "a"), (3, "b"), (None, "c")]
