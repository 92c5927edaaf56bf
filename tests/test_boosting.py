"""Boosted trees: both kinds of rows against a plain version, the grid, and the search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting, models
from riskloom.operators.boosting import UNIT

P = boosting.DEFAULTS | {"subsample": 1.0}


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((500, 4)), 2).astype(np.float32).astype(float)
    x[:, 3] = rng.integers(0, 3, 500)
    y = (x[:, 0] + 0.5 * x[:, 1] * (x[:, 3] > 0) + 0.8 * rng.standard_normal(500) > 0).astype(int)
    return x, y, rng.random(500) < 0.2


@pytest.fixture(scope="module")
def table(spark, numbers):
    x, y, marked = numbers
    return spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), bool(marked[i])) for i in range(500)], "id long, features array<double>, y int, marked boolean").repartition(5).cache()


def plain(x, y, weight, marked, cuts, p, trees):
    """Margins of all rows and the marked rows' loss after each tree, row by row and node by node."""
    own = np.flatnonzero(~marked)
    pos, neg = weight[own][y[own] == 1].sum(), weight[own][y[own] == 0].sum()
    margin, losses = np.full(len(x), math.log(pos / neg)), []
    soft = lambda g: math.copysign(max(abs(g) - p["reg_alpha"], 0), g)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = np.rint((prob - y) * weight * UNIT) / UNIT, np.rint(prob * (1 - prob) * weight * UNIT) / UNIT

        def leaf(rows, depth, everyone):
            gs, hs = g[rows].sum(), h[rows].sum()
            best = None
            if depth < p["max_depth"]:
                for f in range(x.shape[1]):
                    for c in cuts[f]:
                        a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                        if len(a) and len(b) and h[a].sum() >= p["min_child_weight"] and h[b].sum() >= p["min_child_weight"]:
                            gain = sum(soft(g[r].sum()) ** 2 / (h[r].sum() + p["reg_lambda"]) for r in (a, b)) - soft(gs) ** 2 / (hs + p["reg_lambda"])
                            if best is None or gain > best[0] + 1e-12:
                                best = gain, f, c, a, b
            if best and best[0] >= p["gamma"] and best[0] > 1e-6:
                _, f, c, a, b = best
                leaf(a, depth + 1, everyone[x[everyone, f] <= c]), leaf(b, depth + 1, everyone[x[everyone, f] > c])
            else:
                moves[everyone] = -soft(gs) / (hs + p["reg_lambda"]) * p["learning_rate"]

        moves = np.zeros(len(x))
        leaf(own, 0, np.arange(len(x)))
        margin = margin + moves
        losses.append(float(np.logaddexp(0, np.where(y[marked] > 0, -margin[marked], margin[marked])).mean()))
    return margin, losses


def fitted(table, cuts, params, trees, patience=100, held=True, weight=2.0):
    rows = boosting.binned(table, cuts, "features", "y", "id", F.when(F.col("y") == 1, weight).otherwise(1.0), F.col("marked"))
    if not held:
        return boosting.fit_spread(rows, cuts, trees, patience, params)
    m = boosting.held(rows, len(cuts))
    return boosting.fit_held(m, m.marked, np.ones(len(m.y), bool), m.weight, cuts, trees, patience, params)


@pytest.mark.parametrize("params", [{}, {"max_depth": 3, "gamma": 1.0, "reg_alpha": 1.0, "reg_lambda": 10.0, "min_child_weight": 10, "learning_rate": 0.1}])
def test_trees_are_the_plain_ones(table, numbers, params):
    x, y, marked = numbers
    cuts = boosting.quantile_cuts(table, "features")
    p = P | params
    model = fitted(table, cuts, p, 4)
    want, losses = plain(x, y, np.where(y == 1, 2.0, 1.0), marked, cuts, p, 4)
    assert len(model) == int(np.argmin(losses)) + 1 == 4
    np.testing.assert_allclose(model.margin(x), want, atol=1e-9)


def test_rows_that_are_spread_give_the_same_trees(table, numbers, monkeypatch):
    monkeypatch.setattr(boosting, "WRITTEN_EVERY", 2)
    cuts = boosting.quantile_cuts(table, "features")
    params = {"subsample": 0.7, "colsample_bytree": 0.7, "max_depth": 3, "learning_rate": 0.3}
    one, other = (fitted(table, cuts, params, 5, held=h) for h in (True, False))
    assert one.to_json() == other.to_json()
    assert boosting.Trees.from_json(one.to_json()).to_json() == one.to_json()


def test_every_parameter_of_the_grid_changes_trees(table):
    cuts = boosting.quantile_cuts(table, "features")
    assert set(models.GRID) == set(boosting.DEFAULTS)
    for name, values in models.GRID.items():
        said = {fitted(table, cuts, {name: v}, 3).to_json() for v in values}
        assert len(said) == len(values), name


def test_growing_stops_with_patience(table, numbers):
    cuts = boosting.quantile_cuts(table, "features")
    model = fitted(table, cuts, {"learning_rate": 0.5}, 200, patience=5)
    whole = fitted(table, cuts, {"learning_rate": 0.5}, len(model) + 5)
    assert 1 <= len(model) < 100
    assert model.to_json() == whole.first(len(model)).to_json()


def test_probabilities_and_bins_agree(table, numbers):
    x, _, _ = numbers
    cuts = boosting.quantile_cuts(table, "features")
    model = fitted(table, cuts, {}, 6)
    got = {r.id: r.p for r in boosting.probability(model, table, "p").collect()}
    want = 1 / (1 + np.exp(-model.margin(x)))
    assert max(abs(got[i] - want[i]) for i in range(500)) < 1e-12
    bins = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1)
    np.testing.assert_array_equal(boosting.margin_of_bins(model, bins, cuts), model.margin(x))


def test_the_search_is_the_same_held_and_spread(table, monkeypatch):
    draws = models.drawn(2)
    one = models.tuned(table, "y", "id", draws, trees=3, folds=2)
    oof = {r.id: r.p for r in models.out_of_fold(table, "y", "id", {"p": "features"}, trees=3, folds=2).collect()}
    monkeypatch.setattr(boosting, "HELD_BYTES", 0)
    other = models.tuned(table, "y", "id", draws, trees=3, folds=2, in_flight=3)
    assert one[:2] == other[:2] and one[2] == pytest.approx(other[2], abs=1e-12)
    again = {r.id: r.p for r in models.out_of_fold(table, "y", "id", {"p": "features"}, trees=3, folds=2).collect()}
    assert oof == again


def test_errors_of_fits_in_flight_are_raised():
    def bad():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        models._at_once([bad, lambda: 1], 2)
    assert models._at_once([lambda i=i: i for i in range(7)], 3) == list(range(7))


def test_no_rows_and_one_class(spark, table):
    empty = table.limit(0)
    model = models.boosted(empty, "y", "id")
    assert (len(model), model.base) == (0, 0.0)
    assert models.tuned(empty, "y", "id", models.drawn(1))[1:] == (1, 0.5)
    assert boosting.probability(model, empty, "p").count() == 0
    alone = models.boosted(table.where("y = 1"), "y", "id", trees=2)
    assert all(r.p > 0.99 for r in boosting.probability(alone, table, "p").select("p").collect())


def test_a_level_counts_the_smaller_child_only(monkeypatch):
    rng = np.random.default_rng(5)
    bins, n = rng.integers(0, 16, (4000, 3)).astype(np.uint8), 4000
    y = ((bins[:, 0] > 5) ^ (bins[:, 1] > 9)).astype(int)
    seen, counted = [], boosting._Held._counted
    monkeypatch.setattr(boosting._Held, "_counted", lambda self, rows, columns: seen.append(len(rows)) or counted(self, rows, columns))
    m = boosting.Matrix(np.arange(n), y, np.ones(n), np.zeros(n, bool), bins, {})
    model = boosting.fit_held(m, m.marked, ~m.marked, m.weight, [np.arange(15.0)] * 3, 1, 5, {"subsample": 1.0})
    assert len(model) == 1 and seen[0] == n and sum(seen) <= n + 3 * n // 2


def test_queries_that_fit_read_the_texts_once(spark, sf001, monkeypatch):
    from riskloom.plans import catalogue

    staged, stage = [], catalogue.stage
    monkeypatch.setattr(catalogue, "stage", lambda df, name: staged.append(name) or stage(df, name))
    assert len(catalogue._numeric(spark, sf001).inputFiles()) > 0 and staged == ["numeric"]
    assert not any("documents" in f for f in catalogue._numeric(spark, sf001).inputFiles())


def test_rows_that_are_alike_are_one(monkeypatch):
    rng = np.random.default_rng(6)
    n, cuts = 6000, [np.arange(7.0), np.arange(0.0), np.arange(3.0)]
    bins = np.stack([rng.integers(0, 8, n), np.zeros(n), rng.integers(0, 4, n)], 1).astype(np.uint8)
    y = (bins[:, 0] + bins[:, 2] + rng.integers(0, 6, n) > 8).astype(int)
    keys, fold, seen, counted = rng.integers(0, 1 << 60, n), np.arange(n) % 5, [], boosting._Held._counted
    monkeypatch.setattr(boosting._Held, "_counted", lambda self, rows, columns: seen.append(len(rows)) or counted(self, rows, columns))
    for params in ({"subsample": 1.0}, {"subsample": 0.7, "colsample_bytree": 0.7}):
        said = []
        for alike in (True, False):
            m = boosting.Matrix(keys, y, np.ones(n), np.zeros(n, bool), bins, {})
            assert m.cells is not None and len(np.unique(m.cells)) <= 32
            if not alike:
                m.cells = None
            seen.clear()
            model = boosting.fit_held(m, fold == 1, fold != 0, np.where(y == 1, 1.7, 1.0), cuts, 20, 5, params)
            said.append((model.to_json(), m.margin(model, cuts, fold == 0).tolist()))
            assert (max(seen) <= 64) == alike
        assert said[0] == said[1]
    few = boosting.Matrix(np.arange(4), np.zeros(4), np.ones(4), np.zeros(4, bool), np.arange(4, dtype=np.uint8)[:, None], {})
    assert few.cells is None
