"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a long string of bits, the signs of random projections, and sorts its strings. A query descends to the longest prefix that it shares with any string,
then ascends in all trees together, one bit at a time, until the trees hold `target` candidates; these are ranked by exact cosine. It ascends further, again in all trees
together, as long as a vector as near as the k-th one found would have been missed with a chance above `miss`: two vectors at an angle a agree in a bit with a chance of 1 - a / pi.
So the effort follows the data and not the size of the table: where the nearest are near, deep prefixes do; where all vectors are far from each other, much of the table has to be seen.

In Spark vectors lie in blocks, by their string in the first tree, and move once; what the trees exchange is prefixes and numbers of blocks. A query visits the blocks that share its prefix in any tree,
which of a prefix so short that a block holds it anyway are all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage
from .vectors import vectors

#: Bits of a string; rows from which the depth of the first ascent is told; queries that visit a block together.
BITS, SAMPLE, ASKED = 62, 1 << 16, 2048


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees, BITS, dim))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def strings(x: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """The bit strings of rows of x as whole numbers: shape (rows, trees)."""
    place = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
    return np.stack([(x @ n.T > 0) @ place for n in normals], 1)


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), kind).reshape(len(column), -1)


def prefix_range(ordered: np.ndarray, bits: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted strings that share all but the `free` last bits with each of bits begin and end."""
    low = bits >> free << free
    return np.searchsorted(ordered, low), np.searchsorted(ordered, low + (np.int64(1) << free))


def ascend(ordered: np.ndarray, bits: np.ndarray, least: float) -> np.ndarray:
    """For each query (rows of bits, a column a tree) the longest prefix length at which all trees (rows of ordered) together hold `least` strings."""
    short, long = np.zeros(len(bits), np.int64), np.full(len(bits), BITS)
    while (short < long).any():
        depth = (short + long + 1) // 2
        held = np.zeros(len(bits), np.int64)
        for tree, of in zip(ordered, bits.T, strict=True):
            a, b = prefix_range(tree, of, BITS - depth)
            held += b - a
        short, long = np.where(held >= least, depth, short), np.where(held >= least, long, depth - 1)
    return short


def enough(score: np.ndarray, trees: int, miss: float) -> np.ndarray:
    """The longest prefix length at which a vector of this cosine is missed by all trees with a chance of at most `miss`."""
    agree = 1 - np.arccos(np.clip(score, -1, 1)) / np.pi
    need = np.log1p(-(miss ** (1 / trees)))
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(need / np.minimum(np.log(agree), -1e-9)), 0, BITS).astype(np.int32)


def nearest(
    table: DataFrame,
    k: int = 5,
    every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = 64,
    target: int = 1 << 14,
    miss: float = 0.05,
    block_rows: int = 4096,
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k nearest rows found, by cosine, ties to the smaller id.

    A row is never its own answer. Ids are whole numbers; rows with a null id, and null, zero or not wholly finite vectors take no part; of several rows with one id the largest vector in Spark's order counts.
    Vectors of several dimensions are searched among those of equal dimension. Fewer than k rows give as many ranks; an empty table none. Other columns are not read.

    Equal vectors are one string in the trees and one query; their ids come back in at the end. target: candidates of the first ascent, summed over the trees, told from at most SAMPLE rows.
    A block has about block_rows vectors; beyond four times that it is dealt out by id, and the queries of a block go to it in groups of at most about ASKED.
    """
    rows = vectors(table, id_col, vector_col)
    if not rows.groupBy("id").count().where("count > 1").limit(1).isEmpty():
        rows = rows.groupBy("id").agg(F.max("v").alias("v"))
    ask = F.pmod("id", F.lit(every)) == 0
    kinds = stage(rows.groupBy("v").agg(F.min("id").alias("rep"), F.max(ask).alias("ask")).withColumn("dim", F.size("v")), "kinds")
    sizes = {r["dim"]: r["n"] for r in kinds.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return kinds.select(F.col("rep").alias("query_id"), F.lit(1).alias("rank"), F.col("rep").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    copies = stage(rows.join(kinds.select("v", "rep"), "v").select("rep", "id"), "copies")

    depth = {d: max(0, int(np.ceil(np.log2(max(n / block_rows, 1))))) for d, n in sizes.items()}
    first = kinds.select("dim", "v").mapInArrow(_first(depth, trees, seed), "dim int, p0 long").groupBy("dim", "p0").agg(F.count("*").alias("n"))
    parts = first.select("dim", "p0", F.greatest(F.lit(1), F.ceil(F.col("n") / (4.0 * block_rows))).cast("int").alias("parts"))
    hashed = kinds.mapInArrow(_hashed(depth, trees, seed), "rep long, ask boolean, dim int, v array<double>, bits array<long>, p0 long")
    block = F.concat_ws("/", "dim", "p0", F.pmod(F.xxhash64("rep"), "parts"))
    forest = stage(hashed.join(parts, ["dim", "p0"]).select("rep", "ask", "dim", "v", "bits", block.alias("block")), "forest")

    asked = stage(forest.where("ask").select("rep", "dim", "bits").mapInArrow(_depths(forest, sizes, target), "rep long, depth int"), "asked")
    routes = _routes(sizes, block_rows)
    hits = stage(_scored(forest, asked, k + 1, routes), "hits")
    last = hits.groupBy("rep").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    further = F.when(F.col("n") > k, _enough(trees, miss)("score")).otherwise(0)
    again = stage(asked.join(last, "rep").withColumn("to", further).where("to < depth").select("rep", F.col("to").alias("depth")), "again")
    hits = hits.join(again, "rep", "left_anti").unionByName(_scored(forest, again, k + 1, routes))

    smallest = Window.partitionBy("rep").orderBy("id")
    few = copies.withColumn("i", F.row_number().over(smallest)).where(F.col("i") <= k + 1).select(F.col("rep").alias("hit"), F.col("id").alias("vec_id"))
    near = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    found = hits.join(few, "hit").withColumn("i", F.row_number().over(near)).where(F.col("i") <= k + 1).select("rep", "vec_id", "score")
    answers = copies.where(ask).join(found, "rep").where("vec_id <> id").select(F.col("id").alias("query_id"), "vec_id", "score")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            yield dim, batch.filter(pa.array(dims == dim))


def _first(depth: dict[int, int], trees: int, seed: int):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, some in _by_dim(batches):
            bits = strings(scaled(_matrix(some.column("v"), np.float64)), planes(dim, trees, seed)[:1])[:, 0]
            yield pa.RecordBatch.from_arrays([some.column("dim"), pa.array(bits >> (BITS - depth[dim]))], ["dim", "p0"])

    return first


def _hashed(depth: dict[int, int], trees: int, seed: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, some in _by_dim(batches):
            bits = strings(scaled(_matrix(some.column("v"), np.float64)), planes(dim, trees, seed))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * trees, pa.int32()), pa.array(bits.ravel()))
            cols = [*(some.column(x) for x in ("rep", "ask", "dim", "v")), lists, pa.array(bits[:, 0] >> (BITS - depth[dim]))]
            yield pa.RecordBatch.from_arrays(cols, ["rep", "ask", "dim", "v", "bits", "p0"])

    return hashed


def _depths(forest: DataFrame, sizes: dict[int, int], target: int):
    """How deep queries begin: the ascent over the sorted strings of a bounded sample of the vectors."""
    share = {d: min(1.0, SAMPLE / n) for d, n in sizes.items()}
    drawn = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) < F.create_map(*(F.lit(x) for d, s in share.items() for x in (d, int(s * (1 << 30)))))[F.col("dim")]
    sample = forest.where(drawn).select("dim", "bits").toArrow().combine_chunks()
    ordered = {dim: np.sort(_matrix(some.column("bits"), np.int64), 0).T for batch in sample.to_batches() for dim, some in _by_dim([batch])}

    def depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, some in _by_dim(batches):
            bits = _matrix(some.column("bits"), np.int64)
            deep = ascend(ordered[dim], bits, max(1.0, target * share[dim])) if dim in ordered else np.zeros(len(bits))
            yield pa.RecordBatch.from_arrays([some.column("rep"), pa.array(deep.astype(np.int32))], ["rep", "depth"])

    return depths


def _enough(trees: int, miss: float):
    @F.pandas_udf("int")
    def told(score):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(enough(score.to_numpy(), trees, miss))

    return told


def _routes(sizes: dict[int, int], block_rows: int) -> dict[int, list[int]]:
    """For each dimension the prefix lengths by which queries find their blocks: up to where a prefix is of a few vectors only, down to where every block holds all prefixes."""
    least = int(np.ceil(np.log2(block_rows)))
    return {d: list(range(max(least + 1, int(np.log2(n)) - 4), least, -4)) for d, n in sizes.items()}


def _prefixes(routes: dict[int, list[int]]):
    """(rep, dim, tree, depth, prefix) of each query, by the longest route that is no longer than its own prefix; no rows of a query that is on no route."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, some in _by_dim(batches):
            own = some.column("depth").to_numpy()
            depth = np.max([np.where(own >= x, x, 0) for x in [0, *routes[dim]]], 0)
            some, depth = some.filter(pa.array(depth > 0)), depth[depth > 0]
            bits = _matrix(some.column("bits"), np.int64) if len(depth) else np.zeros((0, 1), np.int64)
            n, trees = bits.shape
            row = np.repeat(np.arange(n), trees)
            cols = [some.column("rep").take(pa.array(row)), pa.array(np.full(n * trees, dim, np.int32)), pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(depth[row].astype(np.int32)), pa.array((bits >> (BITS - depth[:, None])).ravel())]
            yield pa.RecordBatch.from_arrays(cols, ["rep", "dim", "tree", "depth", "prefix"])

    return prefixes


def _held(depths: dict[int, list[int]]):
    """(dim, tree, depth, prefix, block): which prefixes of the lengths in use a block holds, each once a batch."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, some in _by_dim(batches):
            names = some.column("block").dictionary_encode()
            block, bits = names.indices.to_numpy(), _matrix(some.column("bits"), np.int64)
            for tree, of in enumerate(bits.T):
                for depth in depths.get(dim, ()):
                    prefix = of >> (BITS - depth)
                    order = np.lexsort((block, prefix))
                    new = np.concatenate([[True], (prefix[order][1:] != prefix[order][:-1]) | (block[order][1:] != block[order][:-1])])
                    at = order[new]
                    cols = [pa.array(np.full(len(at), x, np.int32)) for x in (dim, tree, depth)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(prefix[at]), names.dictionary.take(pa.array(block[at]))], ["dim", "tree", "depth", "prefix", "block"])

    return held


def _scored(forest: DataFrame, asked: DataFrame, k: int, routes: dict[int, list[int]]) -> DataFrame:
    """(rep, hit, score): of all vectors that share a query's prefix of its depth in any tree, the k nearest."""
    queries = forest.join(asked, "rep").select("rep", "dim", "bits", "v", "depth")
    shortest = F.create_map(*(F.lit(x) for d, r in routes.items() for x in (d, min(r, default=BITS + 1))))[F.col("dim")]
    everywhere = queries.where(F.col("depth") < shortest).select("rep", "dim").join(forest.select("dim", "block").distinct(), "dim").select("rep", "block")
    deep: dict[int, list[int]] = {}
    for r in queries.where(F.col("depth") >= shortest).select("dim", "depth").distinct().collect():  # at most BITS numbers a dimension
        deep.setdefault(r["dim"], []).append(max(x for x in routes[r["dim"]] if x <= r["depth"]))
    visits = everywhere
    if deep:
        wanted = queries.select("rep", "dim", "bits", "depth").mapInArrow(_prefixes(routes), "rep long, dim int, tree int, depth int, prefix long")
        held = forest.select("dim", "bits", "block").mapInArrow(_held({d: sorted(set(x)) for d, x in deep.items()}), "dim int, tree int, depth int, prefix long, block string").distinct()
        visits = visits.unionByName(wanted.join(held, ["dim", "tree", "depth", "prefix"]).select("rep", "block").distinct())
    visits = stage(visits, "visits")
    groups = visits.groupBy("block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("groups"))
    going = visits.join(groups, "block").withColumn("group", F.pmod(F.xxhash64("rep"), "groups").cast("int")).join(queries, "rep").select(*(F.col(c).alias(f"q_{c}") for c in ("block", "group", "rep", "bits", "v", "depth")))
    there = forest.join(groups, "block").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("block", "group", "rep", "bits", "v")
    met = going.groupBy("q_block", "q_group").cogroup(there.groupBy("block", "group")).applyInArrow(_ranked(k), "rep long, hit long, score double")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "hit")
    return met.withColumn("i", F.row_number().over(best)).where(F.col("i") <= k).drop("i")


def _ranked(k: int):
    def ranked(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(queries) and len(rows):
            ids, x, bits = rows["rep"].to_numpy(), scaled(_matrix(rows["v"], np.float64)), _matrix(rows["bits"], np.int64)
            own, v, of = queries["q_rep"].to_numpy(), scaled(_matrix(queries["q_v"], np.float64)), _matrix(queries["q_bits"], np.int64)
            free = BITS - queries["q_depth"].to_numpy().astype(np.int64)
            norm, norms = np.sqrt((x * x).sum(1)), np.sqrt((v * v).sum(1))
            order = np.argsort(bits, 0, kind="stable")
            ranges = [prefix_range(bits[order[:, t], t], of[:, t], free) for t in range(bits.shape[1])]
            unit = x / norm[:, None]
            for q in range(len(own)):
                if q % 64 == 0:
                    near = (v[q : q + 64] / norms[q : q + 64, None]) @ unit.T
                seen = np.zeros(len(ids), bool)
                for t, (a, b) in enumerate(ranges):
                    if a[q] < b[q]:
                        seen[order[a[q] : b[q], t]] = True
                at = np.flatnonzero(seen)
                if len(at) > k:  # those that can be of the k nearest, by rounded cosines first
                    rough = near[q % 64][at]
                    at = at[rough >= np.partition(rough, -k)[-k] - 1e-9]
                score = (x[at] * v[q]).sum(1) / (norm[at] * norms[q])
                top = np.lexsort((ids[at], -score))[:k]
                out.append((np.full(len(top), own[q]), ids[at][top], score[top]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], ["rep", "hit", "score"])

    return ranked
