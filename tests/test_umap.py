"""The non-linear reduction against plain measures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import reports, umap


@pytest.fixture(scope="module")
def rolled(spark):
    """Five clusters on a curve in 12 dimensions."""
    rng = np.random.default_rng(0)
    label = np.arange(600) % 5
    x = rng.standard_normal((5, 12))[label] * 4 + 0.4 * rng.standard_normal((600, 12))
    rows = spark.createDataFrame([(int(i), [float(v) for v in x[i]], int(label[i])) for i in range(600)], "id long, v array<double>, label int").repartition(4)
    return x, label, rows.cache()


def test_the_forest_finds_most_neighbours(rolled):
    x, _, rows = rolled
    got = {}
    for r in umap.neighbours(rows, "id", "v", 10).collect():
        got.setdefault(r.id, set()).add(r.near)
    near, _ = umap._nearest(x, x, 10, True)
    assert set(got) == set(range(600)) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[i] & set(near[i].tolist())) / 10 for i in range(600)]) > 0.9


def test_weights_sum_to_their_goal_and_the_graph_is_a_union(spark):
    d = np.sort(np.random.default_rng(1).random((50, 15)) + 0.1, 1)
    w = umap._weights(d)
    assert np.allclose(w[:, 0], 1) and np.allclose(w.sum(1), np.log2(15), atol=1e-6)
    near = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (1, 3, 0.9), (3, 2, 1.0)], "id long, near long, distance double")
    graph = {(r.a, r.b): r.w for r in umap.fuzzy_graph(near).collect()}
    assert all(graph[b, a] == pytest.approx(w) for (a, b), w in graph.items())
    assert graph[1, 2] == pytest.approx(1.0) and 0 < graph[1, 3] < 1 == graph[3, 2]


def test_clusters_stay_and_unseen_rows_fall_in_theirs(rolled):
    x, label, rows = rolled
    train = rows.where("id % 4 <> 0")
    model = umap.fit(train, "id", "v", 2, epochs=60)
    seen = model.ids
    assert seen.tolist() == [i for i in range(600) if i % 4]
    random = np.random.default_rng(2).standard_normal((len(seen), 2))
    assert umap.trustworthiness(x[seen], model.places) > 0.9 > umap.trustworthiness(x[seen], random)
    got = {r.id: np.array(r.reduced) for r in umap.transform(rows, model, "v").collect()}
    centre = np.stack([model.places[label[seen] == c].mean(0) for c in range(5)])
    right = [int(np.argmin(((got[i] - centre) ** 2).sum(1))) == label[i] for i in range(0, 600, 4)]
    assert np.mean(right) > 0.95
    assert np.allclose(got[1], model.places[0])


def test_odd_tables(spark, rolled):
    _, _, rows = rolled
    none = umap.fit(rows.limit(0), "id", "v")
    assert {r.reduced for r in umap.transform(rows.limit(2), none, "v").collect()} == {None}
    few = umap.fit(rows.limit(3), "id", "v", 4, epochs=2)
    null = rows.limit(1).withColumn("v", F.lit(None).cast("array<double>"))
    got = umap.transform(rows.limit(1).unionByName(null), few, "v").collect()
    assert sorted(r.reduced is None for r in got) == [False, True] and len(next(r.reduced for r in got if r.reduced)) == 4
    one = umap.fit(rows.limit(1), "id", "v", 2, epochs=2)
    assert one.places.shape == (1, 2)
    with pytest.raises(ValueError, match="bytes"):
        saved, umap.HELD_BYTES = umap.HELD_BYTES, 10
        try:
            umap.fit(rows, "id", "v")
        finally:
            umap.HELD_BYTES = saved


def test_training_on_the_layout_and_its_saved_models(spark, tmp_path):
    said = F.concat(F.lit("<p>"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.substring(F.sha2(F.concat_ws("/", (F.col("id") * 37 + i) % 90), 256), 1, 6)), " "), F.lit("</p>"))
    rows = spark.range(90).select("id", (F.col("id") % 2).cast("int").alias("label"), said.alias("html"))
    bundle, test, found = reports.train(rows, "id", "html", "label", trees=3, width=8, draws=[], reducer="umap")
    assert found["reducer"] == "umap" and found["reduced_width"] == 8 and test.count() == found["splits"]["test"]
    assert len(bundle.reduction.ids) == found["splits"]["train"]  # fitted on training rows alone
    bundle.save(spark, (tmp_path / "b").as_uri())
    again, _ = reports.Bundle.load(spark, (tmp_path / "b").as_uri())
    assert all(np.array_equal(getattr(again.reduction, x), getattr(bundle.reduction, x)) for x in ("ids", "vectors", "places", "k"))
    pages = rows.withColumn("url", F.lit("http://a.example"))
    shown = lambda b: reports.scan(pages, b, "id", "url", "html").orderBy("id").collect()
    assert shown(again) == shown(bundle)
    none, test, found = reports.train(rows.limit(0), "id", "html", "label", trees=3, width=8, draws=[], reducer="umap")
    assert none.reduction is None and test.count() == 0
    with pytest.raises(ValueError, match="reducer"):
        reports.train(rows, "id", "html", "label", reducer="other")


def test_distances_are_in_memory_in_parts_and_ties_go_to_the_smaller_place(spark, rolled, monkeypatch):
    x, _, rows = rolled
    x = np.round(x)
    x[100:180] = x[7]
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0.0))
    want = np.argsort(d, 1, kind="stable")[:, :15]
    monkeypatch.setattr(umap, "AT_ONCE", 1500)
    seen, cut = [], np.partition
    monkeypatch.setattr(umap.np, "partition", lambda d, *a: seen.append(d.size) or cut(d, *a))
    near, far = umap._nearest(x, x, 15, False)
    assert np.array_equal(near, want) and np.array_equal(far, np.take_along_axis(d, want, 1))
    assert max(seen) <= 1500  # not rows by rows
    near, _ = umap._nearest(x, x, 15, True)
    assert not (near == np.arange(600)[:, None]).any()
    model = umap.Reduction(np.arange(600), x, np.random.default_rng(3).random((600, 2)), 15)
    mean, (names, place) = umap._own(model)
    at = np.searchsorted(names, umap._names(x[[7, 300]]))
    assert np.allclose(mean[at], [model.places[[7, *range(100, 114)]].mean(0), model.places[300]])


def test_a_row_s_place_is_its_own_whatever_is_beside_it(spark, rolled):
    _, _, rows = rolled
    model = umap.fit(rows.where("id % 4 <> 0"), "id", "v", 2, epochs=10)
    far = rows.withColumn("v", F.transform("v", lambda v: v * 1000))
    alone = {r.id: r.reduced for r in umap.transform(rows.coalesce(1), model, "v").collect()}
    mixed = {r.id: r.reduced for r in umap.transform(far.withColumn("id", F.col("id") + 1000).unionByName(rows).coalesce(1), model, "v").collect()}
    assert all(np.allclose(mixed[i], alone[i], atol=1e-9) for i in range(600))
    assert all(alone[int(i)] == p for i, p in zip(model.ids, model.places.tolist()))  # exactly


def test_a_table_of_places_gives_what_a_held_one_does(spark, rolled, monkeypatch):
    _, _, rows = rolled
    train = rows.where("id % 4 <> 0").unionByName(rows.where("id = 1").withColumn("id", F.lit(2000).cast("long")))  # equal vectors
    asked = rows.unionByName(rows.limit(1).withColumn("v", F.lit(None).cast("array<double>")).withColumn("id", F.lit(None).cast("long")))
    model = umap.fit(train, "id", "v", 2, epochs=20)
    want = {r.id: r.reduced for r in umap.transform(asked, model, "v").collect()}
    monkeypatch.setattr(umap, "HELD_BYTES", 10)  # of which a table takes no note
    monkeypatch.setattr(umap, "PART_BYTES", 20 * 12 * 8)
    seen, near = [], umap._nearest_of_parts
    monkeypatch.setattr(umap, "_nearest_of_parts", lambda fitted, asked, k: seen.append(asked.count()) or near(fitted, asked, k))
    fitted = umap.laid(train, "id", "v", 2, epochs=20)
    assert np.allclose([r.place for r in fitted.orderBy("id").collect()], model.places, atol=1e-6)
    got = {r.id: r.reduced for r in umap.placed(asked, fitted, "v").collect()}
    assert seen == [150] and set(got) == set(want) and got[None] is None is want[None]
    assert all(np.allclose(got[i], want[i], atol=1e-6) for i in want if i is not None)
    plan = umap.placed(asked, fitted, "v")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    none = umap.laid(train.limit(0), "id", "v", 2)
    assert {r.reduced for r in umap.placed(asked.limit(3), none, "v").collect()} == {None}
