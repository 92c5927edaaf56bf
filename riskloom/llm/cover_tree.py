"""Embedding near-dedup: exact pairs over a cosine threshold, by dual traversal of cover trees.

Unit vectors whose cosine is c lie sqrt(2 - 2c) apart. The tree's upper level is in Spark: the balls around pivots of a label are its nodes, kept to blocks of bounded size. A pair of nodes is pruned
when its covering radii rule a link out, and taken whole, without moving a row, when they rule one in; of the pairs left, a row goes to those whose other node can hold a partner of its own.
In a pair of blocks, two cover trees of nested levels with halving radii are walked against each other in the same way. Counts and links of the pairs are put together at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, stage
from .vectors import vectors

#: Rows a block is meant to hold, and how many pivots there are at most; beyond that, as wherever a node is overfull, a node is dealt out to blocks by a hash.
BLOCK, PIVOTS = 8192, 1 << 14
_LEAF, _SLACK = 48, 1e-7
#: Rows whose distances to all pivots are at hand together.
_ROWS = 256


def near_groups(table: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) per row: links are pairs of equal, non-null label with cosine >= threshold, in double precision.

    n_links counts other rows linked directly, equal vectors among them; component_id is the smallest id that links reach; kept marks a component's smallest id. Rows with null labels,
    and null, zero or not wholly finite vectors link with nothing, and so do vectors of different lengths. Rows of one id are one node of the groups. A null id has no group, and is kept. An empty table gives no rows.
    """
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    able = vectors(rows.where("label is not null"), "id", "v", "label")
    kinds = able.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    kinds = stage(kinds.select("label", F.size("v").alias("dim"), "v", "rep", "copies", F.monotonically_increasing_id().alias("kid")), "kinds")
    found = stage(_found(kinds, threshold), "found")
    copies = able.join(kinds.select("label", "v", "rep"), ["label", "v"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    groups = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(copies))
    own = kinds.join(found.groupBy("kid").agg(F.sum("links").alias("links")), "kid", "left").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    named = rows.join(own, ["label", "v"], "left").join(groups, F.col("id") == F.col("node"), "left")
    component = F.coalesce("root", F.col("id").cast("long"))
    return named.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


class _Nodes:
    """The upper nodes of one label and dimension: pivots, covering radii, blocks each is dealt out to, copies in it, smallest id."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, n = pivots, len(pivots)
        self.radius, self.blocks, self.copies, self.first = np.full(n, -9.0), np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def far(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * x @ self.pivots.T, 0))

    def between(self, home: np.ndarray) -> np.ndarray:
        """Distances of the pivots of home and all pivots; exactly 0 of a pivot and itself."""
        far = self.far(self.pivots[home])
        far[np.arange(len(home)), home] = 0
        return far


def _found(kinds: DataFrame, threshold: float) -> DataFrame:
    """(kid, rep, links, root): for each vector, in parts, copies of others that it links with, and a smallest id that links reach."""
    total, reach = kinds.count(), float(np.sqrt(2 - 2 * threshold))
    room = max(BLOCK, -(-total // PIVOTS))
    large = kinds.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > 1.5 * room)
    chance = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30) < F.lit(1.0 / room)
    drawn = kinds.where(chance).join(large, ["label", "dim"], "left_semi").select("label", "dim", "v").toPandas()
    nodes = {k: _Nodes(_unit(np.stack(g["v"].to_numpy()))) for k, g in drawn.groupby(["label", "dim"])}
    whole = False
    if nodes:
        homes = kinds.mapInArrow(_homes(nodes), "label string, dim int, node int, far double, rep long, copies long")
        about = homes.groupBy("label", "dim", "node").agg(F.max("far").alias("far"), F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min("rep").alias("first"))
        for r in about.collect():  # a row a pivot
            of, i = nodes[r["label"], r["dim"]], r["node"]
            of.radius[i], of.blocks[i], of.copies[i], of.first[i] = r["far"] + _SLACK, -(-r["n"] // (2 * BLOCK)), r["copies"], r["first"]
            whole |= r["far"] < reach / 2
    dealt = kinds.mapInArrow(_dealt(nodes, reach), "label string, dim int, pair string, side int, v array<double>, rep long, copies long, kid long")
    found = dealt.groupBy("label", "dim", "pair").applyInArrow(_walked(threshold), "kid long, rep long, links long, root long")
    return found.unionByName(kinds.mapInArrow(_whole(nodes, reach), "kid long, rep long, links long, root long")) if whole else found


def _by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    for batch in batches:
        keys = pd.DataFrame({"label": batch.column("label").to_pylist(), "dim": batch.column("dim").to_pylist()})
        for key, at in keys.groupby(["label", "dim"]).indices.items():
            yield key, batch.take(pa.array(at))


def _near_pivots(batches: Iterator[pa.RecordBatch], nodes: dict) -> Iterator[tuple[pa.RecordBatch, _Nodes, np.ndarray, np.ndarray]]:
    """Rows of labels that have nodes, a few at a time: (rows, nodes, distances to pivots, nearest pivot)."""
    for key, some in _by_label(batches):
        for at in range(0, some.num_rows if key in nodes else 0, _ROWS):
            few = some.slice(at, _ROWS)
            far = nodes[key].far(_unit(_matrix(few.column("v"))))
            yield few, nodes[key], far, far.argmin(1)


def _homes(nodes: dict):
    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, _, far, home in _near_pivots(batches, nodes):
            cols = [few.column("label"), few.column("dim"), pa.array(home.astype(np.int32)), pa.array(far.min(1)), few.column("rep"), few.column("copies")]
            yield pa.RecordBatch.from_arrays(cols, ["label", "dim", "node", "far", "rep", "copies"])

    return homes


def _dealt(nodes: dict, reach: float):
    """Rows with the pairs of blocks that they go to, and on which side of the pair they stand."""
    names = ["label", "dim", "pair", "side", "v", "rep", "copies", "kid"]

    def given(some: pa.RecordBatch, row: np.ndarray, pairs: list[str], side: np.ndarray) -> pa.RecordBatch:
        took = some.take(pa.array(row))
        return pa.RecordBatch.from_arrays([took.column("label"), took.column("dim"), pa.array(pairs, pa.string()), pa.array(side.astype(np.int32)), *(took.column(c) for c in names[4:])], names)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, some in _by_label([batch]):
                if key not in nodes:
                    yield given(some, np.arange(some.num_rows), ["0.0-0.0"] * some.num_rows, np.zeros(some.num_rows))
            for few, of, far, home in _near_pivots([batch], nodes):
                apart = of.between(home) - of.radius[home][:, None] - of.radius
                within = of.between(home) + of.radius[home][:, None] + of.radius
                goes = (apart <= reach + _SLACK) & (far <= of.radius + reach + _SLACK) & (within >= reach - 1e-6) & (of.radius >= 0)
                row, node = np.nonzero(goes)
                times = of.blocks[node]
                row, node = np.repeat(row, times), np.repeat(node, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                own = few.column("kid").to_numpy()[row] % of.blocks[home[row]]
                mine, other = np.stack([home[row], own], 1), np.stack([node, block], 1)
                left = (mine[:, 0] < other[:, 0]) | (mine[:, 0] == other[:, 0]) & (mine[:, 1] <= other[:, 1])
                one, two = np.where(left[:, None], mine, other).tolist(), np.where(left[:, None], other, mine).tolist()
                yield given(few, row, [f"{a}.{b}-{c}.{d}" for (a, b), (c, d) in zip(one, two, strict=True)], ~left)

    return dealt


def _whole(nodes: dict, reach: float):
    """What node pairs taken whole give their rows: all copies of the other node's rows, and its smallest id."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, of, _, home in _near_pivots(batches, nodes):
            taken = (of.between(home) + of.radius[home][:, None] + of.radius < reach - 1e-6) & (of.radius >= 0)
            at, rep = np.arange(len(home)), few.column("rep").to_numpy()
            inside = taken[at, home]
            links = taken @ of.copies - np.where(inside, few.column("copies").to_numpy(), 0)
            # the node's smallest id is joined to the other nodes; other rows to the smallest id of their own, or else of one other node
            heads = taken & (rep == of.first[home])[:, None]
            heads[at, np.where(inside, home, taken.argmax(1))] |= taken.any(1)
            row, node = np.nonzero(heads)
            new = np.concatenate([[True] * bool(len(row)), row[1:] != row[:-1]])
            kid = few.column("kid").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kid[row], rep[row], np.where(new, links[row], 0), of.first[node])], ["kid", "rep", "links", "root"])

    return whole


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Node:
    """Members around a centre, within a radius; children with half the radius, or none for a leaf."""

    __slots__ = ("center", "children", "members", "radius")

    def __init__(self, x: np.ndarray, members: np.ndarray, level: float, least: float):
        self.center, self.members, self.children = members[0], members, []
        far = _far(x, members, self.center)
        self.radius = float(far.max()) + _SLACK
        while level > self.radius:
            level /= 2
        if len(members) <= _LEAF or level < least:
            return
        left, picks = members, 0
        while len(left):
            near = _far(x, left, left[0]) <= level
            self.children.append(Node(x, left[near], level / 2, least))
            left, picks = left[~near], picks + 1
            if picks >= 64 and len(left) > 0.5 * len(members):  # balls of this radius hold next to nothing: the rest is one leaf
                rest = Node.__new__(Node)
                rest.center, rest.members, rest.children = left[0], left, []
                rest.radius = float(_far(x, left, left[0]).max()) + _SLACK
                self.children.append(rest)
                break


def _far(x: np.ndarray, members: np.ndarray, center: int) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * x[members] @ x[center], 0))


def links(raw: np.ndarray, copies: np.ndarray, threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the copies of other vectors that it links with, and the smallest index that links reach; with sides, of the other side's vectors alone."""
    x, n = _unit(raw), len(raw)
    counts, label = np.zeros(n, np.int64), np.arange(n)
    reach = float(np.sqrt(2 - 2 * threshold))
    norm = np.sqrt((raw * raw).sum(1))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                return
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label[:] = label[label]

    def compared(a: np.ndarray, b: np.ndarray, same: bool) -> None:
        for at in range(0, len(a), 512):
            p = a[at : at + 512]
            cos = x[p] @ x[b].T
            hit = cos >= threshold
            for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-9), strict=True):
                hit[i, j] = raw[p[i]] @ raw[b[j]] / (norm[p[i]] * norm[b[j]]) >= threshold
            if same:
                hit[np.arange(len(p)), at + np.arange(len(p))] = False
            counts[p] += hit @ copies[b]
            if not same:
                counts[b] += copies[p] @ hit
            i, j = np.nonzero(hit)
            if len(i):
                join(p[i], b[j])

    if side is None:
        root = Node(x, np.arange(n), 2.0, reach / 16)
        stack = [(root, root)]
    else:
        stack = [tuple(Node(x, np.flatnonzero(side == k), 2.0, reach / 16) for k in (0, 1))]
    while stack:
        a, b = stack.pop()
        d = float(np.sqrt(max(2 - 2 * x[a.center] @ x[b.center], 0))) if a is not b else 0.0
        if d > reach + a.radius + b.radius:
            continue
        if d + a.radius + b.radius < reach - 1e-6:  # every pair links
            counts[a.members] += copies[b.members].sum() - (copies[a.members] if a is b else 0)
            if a is not b:
                counts[b.members] += copies[a.members].sum()
            both = np.concatenate([a.members, b.members])
            join(both, np.full(len(both), a.center))
        elif not a.children and not b.children:
            compared(a.members, b.members, a is b)
        elif a is b:
            stack += [(p, q) for k, p in enumerate(a.children) for q in a.children[k:]]
        elif a.children and (not b.children or a.radius >= b.radius):
            stack += [(p, b) for p in a.children]
        else:
            stack += [(a, q) for q in b.children]
    return counts, label


def _walked(threshold: float):
    def walked(pair: pa.Table) -> pa.Table:
        rep, side = pair["rep"].to_numpy(), pair["side"].to_numpy()
        order = np.argsort(rep, kind="stable")
        pair, rep, side = pair.take(pa.array(order)), rep[order], side[order]
        one, two = pair["pair"][0].as_py().split("-")
        if one != two and (side == side[0]).all():  # nobody came from the other side
            counts, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        else:
            counts, label = links(_matrix(pair["v"]), pair["copies"].to_numpy(), threshold, None if one == two else side)
        met = np.flatnonzero((counts > 0) | (label != np.arange(len(rep))))
        return pa.table([pair["kid"].take(pa.array(met)), pa.array(rep[met]), pa.array(counts[met]), pa.array(rep[label[met]])], ["kid", "rep", "links", "root"])

    return walked
