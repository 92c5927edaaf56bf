import itertools
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from riskloom.operators import boosting, dedup, explain, metrics, models, splits
from riskloom.operators.graph import components


def test_copies_join_as_the_rules_say(spark):
    base = "".join(chr(97 + (i * i + 3 * i) % 26) + str(i) for i in range(400))
    rows = [(0, base, 0), (1, base, 1), (2, base + "zz", 0), (3, base + "yy", 1), (4, "ab", 0), (5, "c", 0), (6, "quite another page", 0)]
    got = {r.id: r.group_id for r in dedup.near_groups(spark.createDataFrame(rows, "id long, text string, label int"), "id", "text", "label").collect()}
    assert got[0] == got[1] == got[2] == got[3]  # the same bytes join over labels, near copies within one
    assert got[4] == got[5] != got[0]  # texts without shingles have one signature
    assert sorted(set(got.values())) == [0, 1, 2]


def test_near_copies_of_other_labels_stay_apart(spark):
    base = "".join(chr(97 + (i * i + 3 * i) % 26) + str(i) for i in range(400))
    got = {r.id: r.group_id for r in dedup.near_groups(spark.createDataFrame([(0, base, 0), (1, base + "zz", 1)], "id long, text string, label int"), "id", "text", "label").collect()}
    assert got[0] != got[1]


def test_a_chain_of_near_copies_is_one_group(spark):
    rng = random.Random(3)
    said = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1022))
    rows = [(0, said[:1000], 0), (1, said[:1011], 0), (2, said, 0)]
    runs = [{t[i : i + 5] for i in range(len(t) - 4)} for _, t, _ in rows]
    near = lambda a, b: len(runs[a] & runs[b]) >= 0.98 * len(runs[a] | runs[b])
    assert near(0, 1) and near(1, 2) and not near(0, 2)
    got = dedup.near_groups(spark.createDataFrame(rows, "id long, text string, label int"), "id", "text", "label").collect()
    assert {r.group_id for r in got} == {0}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_no_group_is_in_two_splits(spark):
    rows = spark.range(500).withColumn("g", F.col("id") % 97)
    got = splits.group_split(rows, "g")
    assert got.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert {r.split: r.n for r in got.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()} == {"train": 38, "val": 29, "test": 30}


def test_metrics_with_a_tie(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, s double")
    r = metrics.model_stats(rows, "y", "s").first()
    assert (r.roc_auc, round(r.average_precision, 4), r.tp, r.fp, r.fn, r.tn) == (0.875, 0.8333, 2, 1, 0, 1)
    assert (round(r.precision, 4), r.recall, r.f1) == (0.6667, 1.0, 0.8)


def test_metrics_against_pairs(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40
    got = metrics.curves(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double"), "y", "s").first()
    assert got.roc_auc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]))


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.standard_normal(200) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(200)], "id long, a double, b double, c double, y int")


def test_attributions_add_up_and_are_shapley_values(numbers):
    rows = models.assembled(numbers, ["a", "b", "c"])
    model = models.boosted(rows, "y", "id", trees=6, params={"subsample": 1.0, "max_depth": 5})
    p = {r.id: r.p for r in boosting.probability(model, rows, "p").select("id", "p").collect()}
    for r in explain.tree_attributions(rows, model, ["a", "b", "c"], "id").collect():
        assert 1 / (1 + math.exp(-r.total)) == pytest.approx(p[r.id], abs=1e-9)
        assert [abs(t.impact) for t in r.attributions] == sorted((abs(t.impact) for t in r.attributions), reverse=True)
    found = explain.paths(model)
    x = np.array(rows.select("a", "b", "c").limit(5).collect(), np.float32).astype(float)

    def game(row, known):
        total = model.base
        for p in found:
            for value, features, lows, highs, shares in zip(p.value, p.feature, p.low, p.high, p.share, strict=True):
                total += value * math.prod(share if f >= 0 and f not in known else float(f < 0 or low < row[f] <= high) for f, low, high, share in zip(features, lows, highs, shares, strict=True))
        return total

    phi, base = explain.shapley(x, found, model.base)
    for i, row in enumerate(x):
        for f in range(3):
            others = [k for k in range(3) if k != f]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (game(row, {*s, f}) - game(row, set(s))) for n in range(3) for s in itertools.combinations(others, n))
            assert phi[i, f] == pytest.approx(want)
        assert base == pytest.approx(game(row, set()))


@pytest.mark.parametrize(("balanced", "c"), [(True, 1.0), (False, 1e10)])
def test_leaving_one_out_is_refitting(numbers, balanced, c):
    whole = models.logistic(numbers, "y", ["a", "b"], balanced, c)
    exact = {r.id: r.loo_score for r in models.left_out(numbers, whole, "y", ["a", "b"], balanced, c).collect()}
    near = {r.id: r.loo_score for r in models.left_out(numbers, whole, "y", ["a", "b"], balanced, c, most=10).collect()}
    for i in (0, 50, 120):
        refit = models.logistic(numbers.where(F.col("id") != i), "y", ["a", "b"], balanced, c)
        want = numbers.where(F.col("id") == i).select(models.logistic_score(refit, "a", "b")).first()[0]
        assert exact[i] == pytest.approx(want, abs=1e-6)
        assert near[i] == pytest.approx(want, abs=0.02)
    assert models.left_out(numbers.limit(0), models.logistic(numbers.limit(0), "y", ["a", "b"]), "y", ["a", "b"]).count() == 0


def test_pooling_takes_the_mask(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 1), (1, [9.0, 9.0], 0)], "id long, v array<double>, m int")
    assert models.pooled(rows, "id", "v", "m").first().pooled == [2.0, 3.0]


def test_leaving_one_out_where_probabilities_are_0_or_1_to_the_last_bit(spark):
    rows = spark.createDataFrame([(i, i % 2, (i % 2) * 2.0 - 1.0 + 0.01 * (i % 5)) for i in range(60)] + [(60, 1, 900.0), (61, 0, -900.0)], "id long, y int, a double")
    whole = models.logistic(rows, "y", ["a"], False, 1e10)
    assert {0.0, 1.0} <= {r.p for r in rows.select(models.logistic_score(whole, "a").alias("p")).collect()}
    got = {r.id: r.loo_score for r in models.left_out(rows, whole, "y", ["a"], False, 1e10, most=10).collect()}
    assert len(got) == 62 and all((s > 0.5) == (i == 60 or i < 60 and i % 2 == 1) for i, s in got.items())


def test_parts_of_sets_are_those_worked_out_for_each_row(numbers, monkeypatch):
    x = np.array([[r.a, r.b] for r in numbers.select("a", "b").limit(80).collect()])
    rows = numbers.withColumn("features", F.array("a", "b"))
    model = models.boosted(rows, "y", "id", trees=4)
    told = explain.shapley(x, explain.paths(model), model.base)
    monkeypatch.setattr(explain, "TOLD", 0)
    found = explain.paths(model)
    assert all(p.told is None for p in found)
    plain = explain.shapley(x, found, model.base)
    assert told[1] == plain[1] and np.abs(told[0] - plain[0]).max() < 1e-12
    monkeypatch.setattr(explain, "TOLD", 8)
    found = explain.paths(model)
    monkeypatch.setattr(explain, "_parts", None)  # nothing is worked out by row
    assert np.array_equal(explain.shapley(x, found, model.base)[0], told[0])


def test_the_curve_of_left_out_scores_compiles_where_rows_are_many(spark, numbers):
    whole = models.logistic(numbers, "y", ["a", "b"])
    spark.conf.set("spark.sql.codegen.fallback", "false")  # what doesn't compile is an error
    try:
        left = models.left_out(numbers, whole, "y", ["a", "b"], most=10)
        assert metrics.curves(left, "y", "loo_score").first().roc_auc > 0.5
        assert "EXP" not in left._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


@pytest.mark.parametrize(("balanced", "c"), [(True, 1.0), (False, 1e10)])
def test_left_out_scores_are_refits_however_many_rows_there_are(spark, balanced, c, monkeypatch):
    rng = np.random.default_rng(4)
    a = rng.random(3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-9 * (a - 0.4)))).astype(int)
    a[:3], y[:3] = [0.999, 0.001, 1.5], [0, 1, 0]  # far from what the others tell
    rows = spark.createDataFrame([(i, float(a[i]), float(a[i] ** 2), int(y[i])) for i in range(3000)], "id long, a double, b double, y int").repartition(3).cache()
    whole, far, refits = models.logistic(rows, "y", ["a", "b"], balanced, c), [], models._far_refits
    monkeypatch.setattr(models, "_far_refits", lambda given, y, *more: far.append(len(y)) or refits(given, y, *more))
    got = {r.id: r.loo_score for r in models.left_out(rows, whole, "y", ["a", "b"], balanced, c, most=500).collect()}
    assert len(got) == 3000 and 0 < sum(far) < 60  # the rest are told by one pass
    x = np.stack([np.ones(3000), a, a**2], 1)
    for i in (0, 1, 2, 700, 2999):
        keep, beta = np.arange(3000) != i, np.array([whole.intercept, *whole.coefficients.toArray()])
        weight = np.where(y[keep] == 1, *(2999 / (2 * (y[keep] == k).sum()) for k in (1, 0))) if balanced else np.ones(2999)
        for _ in range(60):
            p = 1 / (1 + np.exp(-x[keep] @ beta))
            curve = (x[keep].T * (weight * p * (1 - p))) @ x[keep] + np.diag([1e-12, 1 / c, 1 / c])
            beta = beta - np.linalg.solve(curve, x[keep].T @ (weight * (p - y[keep])) + np.diag([1e-12, 1 / c, 1 / c]) @ beta)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-x[i] @ beta)), abs=1e-8), i
