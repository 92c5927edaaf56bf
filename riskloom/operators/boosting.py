"""Second-order boosted trees for two classes: quantile bins, gradient histograms summed by node, feature and bin, and stops with patience.

The same growing of trees runs on two kinds of rows: `_Held`, a matrix of bins in one task's memory, and `_Spread`, a table whose histograms Spark sums, one pass a level. Gradients are rounded to whole
multiples of 2^-20 before they are added, so that sums, and so the trees, are the same however the rows lie.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .stages import stage

#: Bins of a feature at most; multiples in which gradients are counted; gain below which nothing is split.
BINS, UNIT, LEAST_GAIN = 256, float(1 << 20), 1e-6
#: Bytes of bins up to which a fit is one task's work; trees after which margins are written anew where it is not.
HELD_BYTES, WRITTEN_EVERY = 64 << 20, 25
DEFAULTS = {"max_depth": 4, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 1.0, "min_child_weight": 1.0, "gamma": 0.0, "reg_alpha": 0.0, "reg_lambda": 1.0}


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-z))


@dataclass(frozen=True)
class Trees:
    """Flat nodes of all trees: a row of at most `cut` in `feature` goes to `left`; feature -1 is a leaf, whose value adds to the margin. cover: Hessian of the rows that were there."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def __len__(self) -> int:
        return len(self.roots)

    def first(self, n: int) -> Trees:
        """The first n trees."""
        end = int(self.roots[n]) if n < len(self) else len(self.feature)
        return Trees(self.base, self.roots[:n], *(getattr(self, k)[:end] for k in ("feature", "cut", "left", "right", "value", "cover")))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, lines = np.full(len(x), self.base), np.ascontiguousarray(x.T)
        feature, cut, left, right, value = (getattr(self, k).tolist() for k in ("feature", "cut", "left", "right", "value"))

        def worth(node: int) -> np.ndarray | float:
            return value[node] if feature[node] < 0 else np.where(lines[feature[node]] <= cut[node], worth(left[node]), worth(right[node]))

        for root in self.roots.tolist() if len(x) else ():
            out += worth(root)
        return out

    def to_json(self) -> str:
        return json.dumps({k: v if isinstance(v, float) else v.tolist() for k, v in vars(self).items()})

    @classmethod
    def from_json(cls, said: str) -> Trees:
        kinds = {"cut": np.float64, "value": np.float64, "cover": np.float64}
        return cls(**{k: float(v) if k == "base" else np.array(v, kinds.get(k, np.int64)) for k, v in json.loads(said).items()})


class _Tree:
    """A tree while it grows, on bins: nodes in the order in which they came up."""

    def __init__(self, g: float, h: float):
        self.feature, self.bin, self.left, self.right, self.sums = [-1], [0], [-1], [-1], [(g, h)]

    def route(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        at, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = feature[at]
            if (f < 0).all():
                return at
            at = np.where(f < 0, at, np.where(bins[every, f] <= cut[at], left[at], right[at]))

    def worth(self, lines: np.ndarray, values: np.ndarray, node: int = 0) -> np.ndarray | float:
        """The value of the leaf that each row comes to; lines: a line of bins a feature."""
        if self.feature[node] < 0:
            return values[node]
        return np.where(lines[self.feature[node]] <= self.bin[node], self.worth(lines, values, self.left[node]), self.worth(lines, values, self.right[node]))

    def split(self, node: int, feature: int, cut: int, left: tuple[float, float], right: tuple[float, float]) -> list[int]:
        self.feature[node], self.bin[node] = feature, cut
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for sums in (left, right):
            self.feature.append(-1), self.bin.append(0), self.left.append(-1), self.right.append(-1), self.sums.append(sums)
        return [self.left[node], self.right[node]]

    def values(self, p: dict) -> np.ndarray:
        """What each node would add as a leaf."""
        g, h = np.array(self.sums).T
        return -_soft(g, p["reg_alpha"]) / (h + p["reg_lambda"]) * p["learning_rate"]


def _soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _drawn_rows(keys: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Whether each row is drawn for a tree, by its key alone."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x < np.uint64(min(int(share * 2**64), 2**64 - 1))


def _drawn_columns(width: int, tree: int, seed: int, share: float) -> np.ndarray:
    return np.sort(np.random.default_rng([seed, tree]).permutation(width)[: max(1, int(width * share))])


def _gradients(y: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _logistic(margin)
    return np.rint((p - y) * weight * UNIT), np.rint(np.maximum(p * (1 - p), 1e-16) * weight * UNIT)


def _losses(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return np.rint(np.logaddexp(0.0, np.where(y > 0, -margin, margin)) * UNIT)


def _histograms(bins: np.ndarray, slot: np.ndarray, columns: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, n_bins: int) -> np.ndarray:
    """(2, slots, columns, bins): sums of both gradients; rows of slot -1 are left out. Whole numbers below 2^53, so that their sums are exact."""
    rows = np.flatnonzero(slot >= 0)
    at = ((slot[rows, None] * len(columns) + np.arange(len(columns))) * n_bins + bins[rows[:, None], columns]).ravel()
    size, shape = slots * len(columns) * n_bins, (slots, len(columns), n_bins)
    each = lambda v: np.bincount(at, np.repeat(v[rows], len(columns)), size).reshape(shape)
    return np.stack([each(g), each(h)])


class _Held:
    """Rows of one task, a line of bins a feature. A level counts the smaller of two children; the other is what is left of their parent, exactly, as sums are whole.

    groups: a number for each row, the same for rows that are alike in bins, label and weight; such rows are one, as often as a tree draws them, and whole sums of them are the same. varied: features that have cuts; the others are in one bin.
    """

    def __init__(self, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, keys: np.ndarray, marked: np.ndarray, base: float, n_bins: int, groups: np.ndarray | None = None, varied: np.ndarray | None = None):
        self.n_bins, self.keys, self.varied = n_bins, keys[~marked], np.ones(bins.shape[1], bool) if varied is None else varied
        self.one, self.of, self.times = _alike(None if groups is None else groups[~marked], np.flatnonzero(~marked))
        kept, _, self.kept_times = _alike(None if groups is None else groups[marked], np.flatnonzero(marked))
        self.lines, self.kept = (np.ascontiguousarray(bins[x].T) for x in (self.one, kept))
        self.y, self.weight, self.kept_y = y[self.one].astype(float), weight[self.one], y[kept].astype(float)
        self.margin, self.kept_margin = np.full(len(self.y), base), np.full(len(self.kept_y), base)

    def start(self, tree: int, p: dict, seed: int) -> float | None:
        self.g, self.h = _gradients(self.y, self.weight, self.margin)
        times = self.times
        if p["subsample"] < 1:
            inside = _drawn_rows(self.keys, tree, seed, p["subsample"])
            times = inside.astype(np.int64) if self.of is None else np.bincount(self.of[inside], minlength=len(self.one))
        if self.of is not None:
            self.g, self.h = self.g * times, self.h * times
        self.nodes = {0: (np.flatnonzero(times), None)}
        return float((_losses(self.kept_y, self.kept_margin) * self.kept_times).sum() / UNIT / self.kept_times.sum()) if len(self.kept_y) else None

    def _counted(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """(2, columns, bins): sums of both gradients over the rows."""
        out, g, h = np.zeros((2, len(columns), self.n_bins)), self.g[rows], self.h[rows]
        out[0, :, 0], out[1, :, 0] = g.sum(), h.sum()
        for i, c in enumerate(columns.tolist()):
            if self.varied[c]:
                at = self.lines[c][rows].astype(np.intp)
                out[0, i], out[1, i] = np.bincount(at, g, self.n_bins), np.bincount(at, h, self.n_bins)
        return out

    def sums(self, tree: _Tree, active: list[int], columns: np.ndarray) -> np.ndarray:
        if active == [0]:
            rows = self.nodes[0][0]
            self.nodes = {0: (rows, self._counted(rows, columns))}
        else:
            above, self.nodes = self.nodes, {}
            for node, (rows, total) in above.items():
                pair = [x for x in (tree.left[node], tree.right[node]) if x in active]
                if not pair:
                    continue
                low = self.lines[tree.feature[node]][rows] <= tree.bin[node]
                parts = sorted(((tree.left[node], rows[low]), (tree.right[node], rows[~low])), key=lambda x: len(x[1]))
                few = self._counted(parts[0][1], columns)
                self.nodes |= {x: (own, few if i == 0 else total - few) for i, (x, own) in enumerate(parts) if x in pair}
        return np.stack([self.nodes[x][1] for x in active], 1)

    def add(self, tree: _Tree, p: dict) -> None:
        values = tree.values(p)
        self.margin += tree.worth(self.lines, values)
        if len(self.kept_y):
            self.kept_margin += tree.worth(self.kept, values)


def _alike(groups: np.ndarray | None, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(a row of each group, place of each row's group, size of each group); each row by itself without groups."""
    if groups is None:
        return rows, None, np.ones(len(rows), np.int64)
    size = np.bincount(groups)
    found = np.flatnonzero(size)
    one, of = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    one[groups], of[found] = rows, np.arange(len(found))
    return one[found], of[groups], size[found]


class _Spread:
    """Rows of a written table (key, y, weight, marked, bins). Trees that came since margins were last written, and the tree that grows, go to the tasks; sums by (node, feature, bin) come back, as many at any number of rows."""

    def __init__(self, rows: DataFrame, base: float, width: int, n_bins: int):
        self.rows, self.width, self.n_bins, self.recent = rows.withColumn("margin", F.lit(base)), width, n_bins, []

    def start(self, tree: int, p: dict, seed: int) -> float | None:
        self.tree, self.p, self.seed = tree, p, seed
        # the loss of the trees so far comes with the first level's sums
        self.first = self._pass(_Tree(0.0, 0.0), [0], _drawn_columns(self.width, tree, seed, p["colsample_bytree"]), True)
        return self.first[1]

    def sums(self, tree: _Tree, active: list[int], columns: np.ndarray) -> np.ndarray:
        return self.first[0] if active == [0] else self._pass(tree, active, columns, False)[0]

    def add(self, tree: _Tree, p: dict) -> None:
        self.recent.append((tree, tree.values(p)))
        if len(self.recent) < WRITTEN_EVERY:
            return
        recent, width = self.recent, self.width

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("margin")
                margin = batch.column(at).to_numpy() + _added(_matrix(batch.column("bins"), width), recent)
                yield batch.set_column(at, "margin", pa.array(margin))

        self.rows, self.recent = stage(self.rows.mapInArrow(added, self.rows.schema), "margins"), []

    def _pass(self, tree: _Tree, active: list[int], columns: np.ndarray, with_loss: bool) -> tuple[np.ndarray, float | None]:
        recent, width, n_bins, number, share, seed = self.recent, self.width, self.n_bins, self.tree, self.p["subsample"], self.seed

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss, n = np.zeros((2, len(active), len(columns), n_bins)), 0.0, 0
            slot_of = np.full(len(tree.feature), -1)
            slot_of[active] = np.arange(len(active))
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, y, marked = _matrix(batch.column("bins"), width), batch.column("y").to_numpy().astype(float), batch.column("marked").to_numpy(zero_copy_only=False)
                margin = batch.column("margin").to_numpy() + _added(bins, recent)
                if with_loss and marked.any():
                    loss, n = loss + _losses(y[marked], margin[marked]).sum(), n + int(marked.sum())
                inside = ~marked & (_drawn_rows(batch.column("key").to_numpy(), number, seed, share) if share < 1 else True)
                g, h = _gradients(y, batch.column("weight").to_numpy(), margin)
                total += _histograms(bins, np.where(inside, slot_of[tree.route(bins)], -1), columns, g, h, len(active), n_bins)
            at = np.flatnonzero((total != 0).any(0).ravel())
            flat = total.reshape(2, -1)[:, at].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(flat[0], int(loss))), pa.array(np.append(flat[1], n))], ["at", "g", "h"])

        got = self.rows.mapInArrow(summed, "at long, g long, h long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        at, g, h = (got.column(c).to_numpy() for c in ("at", "g", "h"))
        out = np.zeros((2, len(active) * len(columns) * n_bins))
        out[0][at[at >= 0]], out[1][at[at >= 0]] = g[at >= 0], h[at >= 0]
        n = int(h[at < 0].sum())
        return out.reshape(2, len(active), len(columns), n_bins), float(g[at < 0].sum() / UNIT / n) if n else None


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.uint8)[begin : begin + len(column) * width].reshape(-1, width) if len(column) * width else np.zeros((len(column), width), np.uint8)


def _added(bins: np.ndarray, trees: list[tuple[_Tree, np.ndarray]]) -> np.ndarray:
    out = np.zeros(len(bins))
    for tree, values in trees:
        out += values[tree.route(bins)]
    return out


def _best_splits(sums: np.ndarray, p: dict) -> list[tuple[float, int, int, tuple[float, float], tuple[float, float]] | None]:
    """Of each slot (gain, column, bin, left sums, right sums): the first of the splits that gain most, if it may be split."""
    g, h = sums / UNIT
    left_g, left_h = np.cumsum(g, -1), np.cumsum(h, -1)
    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    worth = lambda a, b: _soft(a, p["reg_alpha"]) ** 2 / (b + p["reg_lambda"])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = worth(left_g, left_h) + worth(right_g, right_h) - worth(all_g, all_h)
    gain[~((left_h >= p["min_child_weight"]) & (right_h >= p["min_child_weight"]) & (left_h > 0) & (right_h > 0))] = -np.inf
    out: list = []
    for i, best in enumerate(gain.reshape(len(gain), -1).argmax(1).tolist()):
        c, b = divmod(best, gain.shape[2])
        fits = gain[i, c, b] >= p["gamma"] and gain[i, c, b] > LEAST_GAIN
        out.append((gain[i, c, b], c, b, (left_g[i, c, b], left_h[i, c, b]), (right_g[i, c, b], right_h[i, c, b])) if fits else None)
    return out


def grow(rows: _Held | _Spread, width: int, cuts: list[np.ndarray], base: float, trees: int, patience: int, params: dict, seed: int = 42) -> tuple[Trees, list[float]]:
    """(trees, loss of the marked rows after each). With marked rows, growing ends when `patience` trees in a row bring no smaller loss, and those up to the smallest are kept; nothing is fitted twice."""
    p, grown, losses, best, loss = DEFAULTS | params, [], [], 0, None
    for number in range(trees + 1):
        loss = rows.start(number, p, seed) if number < trees or loss is not None else None
        if number and loss is not None:
            losses.append(loss)
            if loss < losses[best]:
                best = number - 1
            if number - 1 - best >= patience:
                break
        if number == trees:
            break
        columns, tree, active = _drawn_columns(width, number, seed, p["colsample_bytree"]), None, [0]
        for _ in range(p["max_depth"]):
            sums = rows.sums(tree or _Tree(0.0, 0.0), active, columns)
            if tree is None:
                tree = _Tree(*(sums[:, 0, 0].sum(1) / UNIT).tolist())
            nodes, active = active, []
            for node, found in zip(nodes, _best_splits(sums, p), strict=True):
                if found:
                    _, c, b, left, right = found
                    # a node with less than two children's least Hessian can't be split
                    active += [x for x in tree.split(node, int(columns[c]), b, left, right) if tree.sums[x][1] >= 2 * p["min_child_weight"]]
            if not active:
                break
        rows.add(tree, p)
        grown.append(tree)
    kept = grown[: best + 1] if losses else grown
    return _flat(kept, cuts, base, p), losses


def _flat(grown: list[_Tree], cuts: list[np.ndarray], base: float, p: dict) -> Trees:
    roots, parts, at = [], {k: [] for k in ("feature", "cut", "left", "right", "value", "cover")}, 0
    for tree in grown:
        roots.append(at)
        inner = np.array(tree.feature) >= 0
        parts["feature"].append(np.array(tree.feature))
        parts["cut"].append(np.array([cuts[f][b] if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin, strict=True)]))
        parts["left"].append(np.where(inner, np.array(tree.left) + at, -1)), parts["right"].append(np.where(inner, np.array(tree.right) + at, -1))
        parts["value"].append(np.where(inner, 0.0, tree.values(p))), parts["cover"].append(np.array(tree.sums)[:, 1])
        at += len(tree.feature)
    return Trees(base, np.array(roots, np.int64), *(np.concatenate(v) if v else np.zeros(0, np.int64 if k in ("feature", "left", "right") else float) for k, v in parts.items()))


def features_array(rows: DataFrame, features_col: str) -> Column:
    return F.col(features_col).cast("array<double>") if dict(rows.dtypes)[features_col].startswith("array") else vector_to_array(features_col)


def quantile_cuts(rows: DataFrame, features_col: str) -> list[np.ndarray]:
    """Of each feature up to BINS - 1 rising cuts, values of its own, none of them its largest; one aggregate over all. Nothing of no rows."""
    x = features_array(rows, features_col)
    first = rows.select(F.size(x).alias("n")).first()
    if first is None:
        return []
    shares = [i / BINS for i in range(1, BINS)]
    given = rows.select(x.alias("x"))
    told = given.agg(*(F.struct(F.percentile_approx(F.col("x")[i], shares, 10_000).alias("q"), F.max(F.col("x")[i]).alias("top")).alias(f"f{i}") for i in range(first["n"]))).first()
    return [np.unique([q for q in c["q"] or [] if q < c["top"]]) for c in told]


def binned(rows: DataFrame, cuts: list[np.ndarray], features_col: str, label_col: str, key_col: str, weight: Column, marked: Column, *more: str) -> DataFrame:
    """(key, y, weight, marked, bins, *more): a byte a feature, the number of cuts below its value."""
    x, width = features_array(rows, features_col), len(cuts)
    given = rows.select(F.xxhash64(key_col).alias("key"), F.col(label_col).cast("int").alias("y"), weight.cast("double").alias("weight"), marked.alias("marked"), *more, x.alias("bins"))
    kinds = ", ".join(f"{c} {k}" for c, k in given.dtypes if c != "bins")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            values = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1)
            out = np.empty((batch.num_rows, width), np.uint8)
            for i, cut in enumerate(cuts):
                out[:, i] = np.searchsorted(cut, values[:, i], "left")
            yield batch.set_column(at, "bins", pa.array([r.tobytes() for r in out], pa.binary()))

    return given.mapInArrow(told, f"{kinds}, bins binary")


@dataclass
class Matrix:
    """Rows that are few enough for a task, in columns; `more` has further columns by name."""

    keys: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    marked: np.ndarray
    bins: np.ndarray
    more: dict[str, np.ndarray]

    @cached_property
    def cells(self) -> np.ndarray | None:
        """A number for each row, the same for rows of the same bins; None if more than half of the rows have bins of their own."""
        code, size, n = np.zeros(len(self.y), np.int64), 1, len(self.y)
        for column in self.bins.T if n else ():
            if size << 8 >= 1 << 62:
                found, code = np.unique(code, return_inverse=True)
                if (size := len(found)) * 2 > n:
                    return None
            top = int(column.max()) + 1
            code, size = code * top + column, size * top
        found, code = np.unique(code, return_inverse=True)
        return code if len(found) * 2 <= n else None

    def margin(self, model: Trees, cuts: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """The margin of the rows, worked out once for rows of the same bins."""
        one, of, _ = _alike(None if self.cells is None else self.cells[rows], np.flatnonzero(rows))
        margin = margin_of_bins(model, self.bins[one], cuts)
        return margin if of is None else margin[of]


def held(rows: DataFrame, width: int) -> Matrix | None:
    """The rows of a written binned() table, if their bins take at most HELD_BYTES; their number is counted first."""
    if rows.count() * max(width, 1) > HELD_BYTES:
        return None
    got = rows.toArrow().combine_chunks().sort_by("key")
    col = lambda c: got.column(c).to_numpy(zero_copy_only=False)
    bins = np.concatenate([np.zeros((0, width), np.uint8), *(_matrix(x, width) for x in got.column("bins").chunks)])
    return Matrix(*map(col, ("key", "y", "weight", "marked")), bins, {c: col(c) for c in got.column_names if c not in ("key", "y", "weight", "marked", "bins")})


def base_margin(pos: float, neg: float) -> float:
    """The log-odds of the weighed share of positives, within bounds; 0 without rows."""
    p = pos / (pos + neg) if pos + neg else 0.5
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def fit_held(m: Matrix, marked: np.ndarray, keep: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], trees: int, patience: int, params: dict, seed: int = 42) -> Trees:
    """Trees of the rows that `keep` names, of which `marked` tell when to stop. weight: by row."""
    n_bins = max((len(c) for c in cuts), default=0) + 1
    own = keep & ~marked
    units = np.rint(weight * UNIT)
    base = base_margin(float(units[own & (m.y == 1)].sum()), float(units[own & (m.y != 1)].sum()))
    if not own.any():
        return _flat([], cuts, base, DEFAULTS)
    groups = None if m.cells is None else m.cells * 2 + (m.y == 1)
    if groups is not None:
        told = np.zeros((2, groups.max() + 1))
        told[:, groups] = m.y, weight
        groups = groups[keep] if (told[:, groups] == (m.y, weight)).all() else None
    rows = _Held(m.bins[keep], m.y[keep], weight[keep], m.keys[keep], marked[keep], base, n_bins, groups, np.array([len(c) > 0 for c in cuts], bool))
    return grow(rows, len(cuts), cuts, base, trees, patience, params, seed)[0]


def fit_spread(rows: DataFrame, cuts: list[np.ndarray], trees: int, patience: int, params: dict, seed: int = 42) -> Trees:
    """The same trees of a written binned() table, whose rows stay where they are."""
    sums = {r["y"]: r["w"] for r in rows.where("not marked").groupBy("y").agg(F.sum(F.rint(F.col("weight") * UNIT).cast("long")).alias("w")).collect()}
    base = base_margin(float(sums.get(1, 0)), float(sums.get(0, 0)))
    if not sums:
        return _flat([], cuts, base, DEFAULTS)
    return grow(_Spread(rows, base, len(cuts), max((len(c) for c in cuts), default=0) + 1), len(cuts), cuts, base, trees, patience, params, seed)[0]


def fit(rows: DataFrame, label_col: str, id_col: str, features_col: str, weight: Column, marked: Column, trees: int, patience: int, params: dict, seed: int = 42) -> Trees:
    """Trees of the rows that aren't marked, as many as the marked ones' loss bears out. Nothing of no rows."""
    cuts = quantile_cuts(rows, features_col)
    table = stage(binned(rows, cuts, features_col, label_col, id_col, weight, marked), "binned")
    m = held(table, len(cuts))
    if m is None:
        return fit_spread(table, cuts, trees, patience, params, seed)
    return in_tasks(rows.sparkSession, m, cuts, [lambda m, cuts: fit_held(m, m.marked, np.ones(len(m.y), bool), m.weight, cuts, trees, patience, params, seed).to_json()], Trees.from_json)[0]


def in_tasks(spark, m: Matrix, cuts: list[np.ndarray], work: list, read) -> list:
    """What each of work, a function of (matrix, cuts), says, in order: one Spark task each, all in flight at once. The matrix is broadcast; held() has bounded it."""
    known, jobs = spark.sparkContext.broadcast((m, cuts)), list(work)

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([jobs[i](*known.value)])], ["i", "said"])

    got = spark.range(0, len(jobs), 1, max(len(jobs), 1)).mapInArrow(done, "i long, said string").collect()
    return [read(r["said"]) for r in sorted(got, key=lambda r: r["i"])]


def probability(model: Trees, rows: DataFrame, out: str, features_col: str = "features") -> DataFrame:
    """rows with the chance of label 1."""

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        values = x.flatten().to_numpy().reshape(len(x), -1) if len(x) else np.zeros((0, 1))
        return pa.array(_logistic(model.margin(values)))

    return rows.withColumn(out, scored(features_array(rows, features_col)))


def probability_by(models: list[Trees], rows: DataFrame, out: str, features_col: str, by_col: str) -> DataFrame:
    """rows with the chance of label 1 by the model whose number is in by_col."""

    @F.arrow_udf("double")
    def scored(x: pa.Array, by: pa.Array) -> pa.Array:
        which, result = by.to_numpy(), np.zeros(len(x))
        values = x.flatten().to_numpy().reshape(len(x), -1) if len(x) else np.zeros((0, 1))
        for k in np.unique(which).tolist():
            result[which == k] = _logistic(models[k].margin(values[which == k]))
        return pa.array(result)

    return rows.withColumn(out, scored(features_array(rows, features_col), F.col(by_col).cast("int")))


def margin_of_bins(model: Trees, bins: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The margin of binned rows: a bin stands for the cut above it."""
    x = np.empty(bins.shape)
    for i, cut in enumerate(cuts):
        x[:, i] = np.append(cut, np.inf)[bins[:, i]]
    return model.margin(x)
