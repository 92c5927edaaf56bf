"""Non-linear reduction: a fuzzy graph of near neighbours, laid out by edge-sampled descent.

Neighbours come from a forest of random hyperplanes whose leaves are runs of a sorted table, so that no leaf is large, whatever the data; weights and their symmetric union are DataFrame work; the layout moves all rows in rounds:
in a round each task takes its rows' edges through some epochs against the coordinates of the round's beginning, which every task gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .models import reduced, reducer
from .rows import met
from .stages import stage

#: Neighbours of a row, trees, rows of a leaf at most, hyperplanes of a tree.
NEIGHBOURS, TREES, LEAF, PLANES = 15, 8, 256, 16
#: Epochs, how many of them make a round, rows that push away at each pull; curve of distances for a least distance of 0.1 and a spread of 1.
EPOCHS, ROUND, PUSHES, CURVE = 200, 10, 5, (1.577, 0.895)
#: Bytes of coordinates and vectors that go to every task; distances that a task has in memory at once.
HELD_BYTES, AT_ONCE = 256 << 20, 1 << 21
#: Bytes of fitted vectors that a task holds while other rows pass them; parts of these at least.
PART_BYTES, LEAST_PARTS = 32 << 20, 16


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _nearest(x: np.ndarray, y: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k rows of y nearest to each row of x, itself left out if x is y; ties to the smaller place."""
    k, length, size = min(k, len(y) - same), (y**2).sum(1), max(1, AT_ONCE // max(len(y), 1))
    at, far = np.zeros((len(x), max(k, 0)), np.int64), np.zeros((len(x), max(k, 0)))
    for begin in range(0, len(x) if k > 0 else 0, size):
        part = x[begin : begin + size]
        d = part @ y.T
        d *= -2
        d += (part**2).sum(1)[:, None]
        d += length
        np.sqrt(np.maximum(d, 0.0, out=d), out=d)
        if same:
            d[np.arange(len(part)), np.arange(begin, begin + len(part))] = np.inf
        # all as near as the k-th, of which ties are many, in the order of rows, distances and places
        row, place = np.nonzero(d <= np.partition(d, k - 1, 1)[:, k - 1 : k])
        found = d[row, place]
        order = np.lexsort((place, found, row))
        first = order[np.searchsorted(row, np.arange(len(part)))[:, None] + np.arange(k)]
        at[begin : begin + size], far[begin : begin + size] = place[first], found[first]
    return at, far


def neighbours(rows: DataFrame, id_col: str, vector_col: str, k: int = NEIGHBOURS, trees: int = TREES, seed: int = 42) -> DataFrame:
    """(id, near, distance): the k nearest of each row that a forest finds, by Euclidean distance. Ids are unique.

    A tree orders rows by the signs of their projections on hyperplanes; runs of LEAF rows of that order are its leaves, compared within. Rows and projections are written once a tree; a row sends its k best of each leaf, not its pairs.
    """
    first = rows.select(F.size(vector_col).alias("n")).first()
    if first is None:
        return rows.select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("near"), F.lit(0.0).alias("distance")).limit(0)
    planes = np.random.default_rng(seed).standard_normal((trees * PLANES, first["n"]))
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0), _vectors(batch.column(1))
            p = x @ planes.T
            for t in range(trees):
                code = ((p[:, t * PLANES : (t + 1) * PLANES] > 0) << np.arange(PLANES)[::-1]).sum(1)
                # rows of one code go by how far they are along the next tree's first plane
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code), pa.array(p[:, (t + 1) * PLANES % (trees * PLANES)]), ids, batch.column(1)], ["tree", "code", "along", "id", "v"])

    order = ["tree", "code", "along", "id"]
    ordered = given.mapInArrow(coded, "tree int, code long, along double, id long, v array<double>").repartitionByRange(*order).sortWithinPartitions(*order)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def leaves(last: bool) -> Iterator[pa.RecordBatch]:
            tree, ids, x = (np.concatenate(v) for v in zip(*held, strict=True))
            at = 0
            while at < len(ids) and (last or len(ids) - at >= 2 * LEAF):
                end = at + LEAF if len(ids) - at >= 2 * LEAF else len(ids)
                other = int(np.argmax(tree[at:end] != tree[at]))  # a leaf is of one tree
                end = at + other if other else end
                near, d = _nearest(x[at:end], x[at:end], k, True)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at:end], near.shape[1])), pa.array(ids[at:end][near].ravel()), pa.array(d.ravel())], ["id", "near", "distance"])
                at = end
            held[:] = [(tree[at:], ids[at:], x[at:])]

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(3).to_numpy(), _vectors(batch.column(4))))
                yield from leaves(False)
        if held:
            yield from leaves(True)

    found = ordered.mapInArrow(within, "id long, near long, distance double").groupBy("id", "near").agg(F.min("distance").alias("distance"))
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "near"))), 1, k).alias("best"))
    return best.select("id", F.explode("best").alias("b")).select("id", "b.near", "b.distance")


def _weights(d: np.ndarray) -> np.ndarray:
    """Weights of sorted distances, by row: 1 for the nearest, and so that they sum to log2 of their number."""
    rho, low, high, sigma, goal = d[:, :1], np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d)), np.log2(max(d.shape[1], 2))
    for _ in range(64):
        total = np.exp(-np.maximum(d - rho, 0) / sigma[:, None]).sum(1)
        high, low = np.where(total > goal, sigma, high), np.where(total > goal, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
    sigma = np.maximum(sigma, 1e-3 * np.maximum(d.mean(1), 1e-12))
    return np.exp(-np.maximum(d - rho, 0) / sigma[:, None])


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """(a, b, w) in both directions: the union of both rows' views, w1 + w2 - w1 w2."""
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "near"))).alias("best"))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, best = batch.column(0).to_numpy(), batch.column(1)
            length, flat = best.value_lengths().to_numpy(), best.flatten()
            d, near, begin = flat.field("distance").to_numpy(), flat.field("near").to_numpy(), np.cumsum(length) - length
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                at = begin[rows, None] + np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], n)), pa.array(near[at].ravel()), pa.array(_weights(d[at]).ravel())], ["a", "b", "w"])

    one = lists.mapInArrow(weighed, "a long, b long, w double")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg((F.sum("w") - F.when(F.count("*") > 1, F.product("w")).otherwise(0.0)).alias("w"))


@dataclass
class Reduction:
    """Fitted rows: ids, vectors and coordinates, by rising id."""

    ids: np.ndarray
    vectors: np.ndarray
    places: np.ndarray
    k: int

    def some(self) -> Reduction | None:
        """Itself, None if no row was fitted."""
        return self if len(self.ids) else None

    def save(self, spark: SparkSession, path: str) -> None:
        """A row a fitted row; HELD_BYTES bounds them."""
        rows = pa.table([pa.array(self.ids, pa.int64()), *map(_lists, (self.vectors, self.places)), pa.array(np.full(len(self.ids), self.k))], ["id", "vector", "place", "k"])
        spark.createDataFrame(rows).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Reduction:
        rows = spark.read.parquet(path).orderBy("id").toArrow().combine_chunks()
        vectors, places = (_vectors(pa.concat_arrays(rows.column(c).chunks)) for c in ("vector", "place"))
        return cls(rows.column("id").to_numpy(), vectors, places, rows.column("k")[0].as_py())


def _moved(places: np.ndarray, own: np.ndarray, head: np.ndarray, tail: np.ndarray, weight: np.ndarray, begin: int, epochs: int, total: int, seed: int) -> np.ndarray:
    """own after some epochs: edges are drawn by their weights, each pulls its row to the other end, and PUSHES rows drawn by chance push it away."""
    a, b = CURVE
    for epoch in range(begin, begin + epochs):
        rng = np.random.default_rng([seed, epoch, int(head[0]) if len(head) else 0])
        rate = 1.0 - epoch / total
        drawn = rng.random(len(head)) < weight
        h, t = head[drawn], tail[drawn]
        gap = own[h] - places[t]
        d2 = (gap**2).sum(1)
        pull = -2 * a * b * d2 ** (b - 1) / (1 + a * d2**b)
        moves = np.clip(np.where(d2 > 0, pull, 0.0)[:, None] * gap, -4, 4)
        for _ in range(PUSHES):
            gap = own[h] - places[rng.integers(0, len(places), len(h))]
            d2 = (gap**2).sum(1)
            moves += np.clip(np.where(d2 > 0, 2 * b / ((0.001 + d2) * (1 + a * d2**b)), 0.0)[:, None] * gap, -4, 4)
        step = np.stack([np.bincount(h, c, len(own)) for c in moves.T], 1)
        own = own + rate * step / np.maximum(np.bincount(h, minlength=len(own)), 1)[:, None] ** 0.5
    return own


def _given(train: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return stage(train.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")), "vectors")


def fit(train: DataFrame, id_col: str, vector_col: str, width: int = 2, k: int = NEIGHBOURS, epochs: int = EPOCHS, seed: int = 42) -> Reduction:
    """Coordinates of the training rows, from principal components on. Ids are unique; rows without a vector take no part; of no rows comes an empty reduction.

    A reduction is told to all tasks with its vectors, which HELD_BYTES bounds; more training rows than that are an error, to be met by laid() and placed(), which keep them in a table.
    """
    train = _given(train, id_col, vector_col)
    n, longest = train.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if n * (longest + width) * 8 > HELD_BYTES:
        raise ValueError(f"{n} rows of {longest} numbers are more than {HELD_BYTES} bytes")
    if not n:
        return Reduction(np.zeros(0, np.int64), np.zeros((0, longest)), np.zeros((0, width)), k)
    ids, places = _settled(train, width, k, epochs, seed)
    return Reduction(ids, _vectors(train.orderBy("id").toArrow().column("v").combine_chunks()), places, k)


def laid(train: DataFrame, id_col: str, vector_col: str, width: int = 2, k: int = NEIGHBOURS, epochs: int = EPOCHS, seed: int = 42) -> DataFrame:
    """(id, v, place): fit()'s rows as a written table, at any number of rows. The driver and the tasks have the coordinates alone, 8 (width + 1) bytes a row; vectors stay in the table."""
    train = _given(train, id_col, vector_col)
    if train.isEmpty():
        return train.withColumn("place", F.lit(None).cast("array<double>"))
    known = train.sparkSession.sparkContext.broadcast(_settled(train, width, k, epochs, seed))

    @F.arrow_udf("array<double>")
    def place(id: pa.Array) -> pa.Array:
        ids, places = known.value
        return _lists(places[np.searchsorted(ids, id.to_numpy())])

    return stage(train.withColumn("place", place("id")), "laid")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _settled(train: DataFrame, width: int, k: int, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and coordinates of the rows (id, v) of a written table."""
    begun = reduced(train, reducer(train, "v", width), "v").select("id", F.slice("reduced", 1, width).alias("reduced")).orderBy("id").toArrow()
    ids, places = begun.column("id").to_numpy(), _vectors(begun.column("reduced").combine_chunks())
    places = np.pad(places, ((0, 0), (0, width - places.shape[1])))
    places = 10 * (places - places.mean(0)) / max(np.abs(places - places.mean(0)).max(), 1e-12) + np.random.default_rng(seed).normal(0, 1e-4, places.shape)
    graph = stage(fuzzy_graph(neighbours(train, "id", "v", k, seed=seed)).repartition("a").sortWithinPartitions("a", "b"), "graph")
    context = train.sparkSession.sparkContext
    for begin in range(0, epochs, ROUND):
        known = context.broadcast((ids, places))

        def moved(batches: Iterator[pa.RecordBatch], begin: int = begin, known=known) -> Iterator[pa.RecordBatch]:
            edges = [tuple(c.to_numpy() for c in batch.columns) for batch in batches if batch.num_rows]
            if not edges:
                return
            ids, places = known.value
            a, b, w = (np.concatenate(x) for x in zip(*edges, strict=True))
            mine, head = np.unique(a, return_inverse=True)
            own = _moved(places, places[np.searchsorted(ids, mine)], head, np.searchsorted(ids, b), w / w.max(), begin, min(ROUND, epochs - begin), epochs, seed)
            yield pa.RecordBatch.from_arrays([pa.array(mine), _lists(own)], ["id", "place"])

        got = graph.mapInArrow(moved, "id long, place array<double>").toArrow()
        known.destroy()
        if got.num_rows:
            places = places.copy()
            places[np.searchsorted(ids, got.column("id").to_numpy())] = _vectors(got.column("place").combine_chunks())
    return ids, places


def _drawn_to(d: np.ndarray) -> np.ndarray:
    """Weights of a row's nearest fitted rows; where some are equal to it, of these alone."""
    return np.where(d[:, :1] <= 1e-9, d <= 1e-9, _weights(d))


def _names(x: np.ndarray) -> np.ndarray:
    """A 64-bit name of each vector; -0.0 is 0.0."""
    out = np.zeros(len(x), np.uint64)
    for column in np.ascontiguousarray((x + 0.0).T).view(np.uint64):
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _own(model: Reduction) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(coordinates, (names in order, a place of each)) of the fitted vectors: where some are equal, the mean of the first k of them."""
    name = _names(model.vectors)
    order = np.argsort(name, kind="stable")
    names, begin = np.unique(name[order], return_index=True)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    which = np.repeat(np.arange(len(names)), np.diff(np.append(begin, len(order))))[rank < model.k]
    few = order[rank < model.k]
    count = np.maximum(np.bincount(which, minlength=len(names)), 1)
    mean = np.stack([np.bincount(which, c[few], len(names)) / count for c in model.places.T], 1) if model.places.shape[1] else np.zeros((len(names), 0))
    return mean, (names, order[begin])


def transform(rows: DataFrame, model: Reduction, vector_col: str, out: str = "reduced") -> DataFrame:
    """rows with their coordinates: those of the fitted rows nearest to each, by their fuzzy weights; a fitted row's own where the vector is one of theirs. Null vectors, and all rows under an empty reduction, get null.

    Vectors of fitted rows are looked up; the rest are held against all fitted rows, AT_ONCE distances at a time.
    """
    known = rows.sparkSession.sparkContext.broadcast((model, *_own(model)))

    @F.arrow_udf("array<double>")
    def placed(v: pa.Array) -> pa.Array:
        (m, own, copies), given = known.value, v.is_valid().to_numpy(zero_copy_only=False)
        result: list = [None] * len(v)
        if given.any() and len(m.ids):
            x = _vectors(v.drop_null())
            name = _names(x)
            at = np.minimum(np.searchsorted(copies[0], name), len(copies[0]) - 1)
            same = (copies[0][at] == name) & (m.vectors[copies[1][at]] == x).all(1)
            places = np.empty((len(x), m.places.shape[1]))
            places[same] = own[at[same]]
            near, d = _nearest(x[~same], m.vectors, m.k, False)
            w = _drawn_to(d)
            places[~same] = (w[..., None] * m.places[near]).sum(1) / w.sum(1, keepdims=True)
            for i, place in zip(np.flatnonzero(given), places.tolist(), strict=True):
                result[i] = place
        return pa.array(result, pa.list_(pa.float64()))

    return rows.withColumn(out, placed(F.col(vector_col).cast("array<double>")))


def _nearest_of_parts(fitted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(n, near, distance): of each asked row (n, v) the k nearest of the fitted rows (id, v), exactly.

    Fitted rows are dealt to parts of PART_BYTES at most, and a task holds one of them, past which all asked rows stream. That is (asked) x (fitted) distances, and a copy of the asked rows for each part.
    """
    n, longest = fitted.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    parts = max(LEAST_PARTS, -(-n * longest * 8 // PART_BYTES))
    held = fitted.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.lit(0).alias("kind"), F.col("id").alias("n"), "v")
    passed = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(1).alias("kind"), "n", "v")
    dealt = held.unionByName(passed).repartitionByRange(parts, "part").sortWithinPartitions("part", "kind", "n")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = -1, [], []
        for batch in batches:
            part, kind, number = (batch.column(i).to_numpy() for i in range(3))
            ends = np.flatnonzero(np.diff(part * 2 + kind)) + 1 if batch.num_rows else []
            for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True) if batch.num_rows else ():
                x = _vectors(batch.column(3).slice(a, b - a))
                if part[a] != at:
                    at, ids, vectors = part[a], [], []
                if kind[a] == 0:
                    ids.append(number[a:b]), vectors.append(x)
                elif ids:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    near, d = _nearest(x, vectors[0], k, False)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(number[a:b], near.shape[1])), pa.array(ids[0][near].ravel()), pa.array(d.ravel())], ["n", "near", "distance"])

    best = dealt.mapInArrow(found, "n long, near long, distance double").groupBy("n").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "near"))), 1, k).alias("best"))
    return best.select("n", F.explode("best").alias("b")).select("n", "b.near", "b.distance")


def placed(rows: DataFrame, fitted: DataFrame, vector_col: str, k: int = NEIGHBOURS, out: str = "reduced") -> DataFrame:
    """transform() by a table of laid(): vectors meet by sorted joins, and no task or driver has them all. Places are worked out once for equal vectors."""
    rows = rows.withColumn("_v", F.col(vector_col).cast("array<double>"))
    first = fitted.select(F.size("place")).first()
    width = first[0] if first else 0
    some = fitted.withColumn("_i", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_i") <= k)
    own = some.groupBy("v").agg(F.array(*(F.avg(F.col("place")[i]) for i in range(width))).cast("array<double>").alias("own")).select(F.col("v").alias("_v"), "own")
    wanted = stage(met(rows.where("_v is not null").select("_v").distinct(), own, "_v", "left").withColumn("_n", F.monotonically_increasing_id()), "wanted")
    near = stage(_nearest_of_parts(fitted, wanted.where("own is null").select(F.col("_n").alias("n"), F.col("_v").alias("v")), k), "near")
    lists = met(near, fitted.select(F.col("id").alias("near"), "place"), "near").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("distance", "near", "place"))).alias("best"))

    @F.arrow_udf("array<double>")
    def between(best: pa.Array) -> pa.Array:
        length, flat, result = best.value_lengths().to_numpy(), best.flatten(), np.zeros((len(best), width))
        d, places, begin = flat.field("distance").to_numpy(), _vectors(flat.field("place")), np.cumsum(length) - length
        for n in np.unique(length).tolist():
            of = np.flatnonzero(length == n)
            at = begin[of, None] + np.arange(n)
            w = _drawn_to(d[at])
            result[of] = (w[..., None] * places[at]).sum(1) / w.sum(1, keepdims=True)
        return _lists(result)

    told = met(wanted, lists.select(F.col("n").alias("_n"), between("best").alias("_told")), "_n", "left").select("_v", F.coalesce("own", "_told").alias(out))
    return met(rows, told, "_v", "left").drop("_v")


def trustworthiness(x: np.ndarray, y: np.ndarray, k: int = 12) -> float:
    """How far near rows of y are near in x (Venna and Kaski): 1 if all are."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    rank = d.argsort(1).argsort(1) + 1
    near, _ = _nearest(y, y, k, True)
    return 1.0 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * float(np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum())
