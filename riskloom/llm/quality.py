"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, slices, unused

_EDGE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)
#: Document-level shares are told in so many steps.
STEPS = 8
#: Bytes of text that are Python strings together; words remembered in a worker, and the longest of them.
HELD, WORDS, LONGEST = 1 << 21, 1 << 16, 64
#: Each share counts as so many features, to stand beside many words.
SHARES = 16


class _Features(dict):
    """Raw token to the numbers of its features (the word in lower case and its first letters), then flags: marks beside it, capitals, no letters, digits."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def number(self, feature: str) -> int:
        return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) & self.mask

    def __missing__(self, token: str) -> tuple[tuple[int, ...], int]:
        if len(self) > WORDS:
            self.clear()
        before, word, after = _EDGE.match(token).groups()
        low = word.lower()
        found = [f"w{low}"] * bool(word) + [f"p{low[:5]}"] * (len(low) > 5)
        flags = (len(after) + len(before) > 1) | (len(word) > 1 and word.isupper()) << 1 | (not word) << 2 | any(map(str.isdigit, word)) << 3
        got = tuple(map(self.number, found)), flags
        if len(token) <= LONGEST:
            self[token] = got
        return got


def features(text: str, cache: _Features) -> np.ndarray:
    """Distinct feature numbers of the whole text: its words, and in steps the shares of its tokens with each flag, of repeated lines and of repeated words."""
    tokens = Counter(text.split())
    got: set[int] = set()
    n, shares = max(tokens.total(), 1), [0] * 4
    for token, times in tokens.items():
        numbers, flags = cache[token]
        got.update(numbers)
        if flags:
            for k in range(4):
                shares[k] += times * (flags >> k & 1)
    lines = [x for x in text.split("\n") if x.strip()]
    told = [x / n for x in shares] + [1 - len(set(lines)) / max(len(lines), 1), len(tokens) / n]
    got.update(cache.number(f"share {k} {int(x * STEPS)} {again}") for k, x in enumerate(told) for again in range(SHARES))
    got.add(cache.number(f"length {n.bit_length()}"))
    return np.fromiter(got, np.int32, len(got))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade >= k) = sigmoid(weights . x - thresholds[k - 1]), the thresholds rising."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int


def fit(rated: DataFrame, grades: int, bits: int = 18, max_rows: int = 20_000, penalty: float = 3e-5, steps: int = 60, text_col: str = "text", grade_col: str = "grade", id_col: str = "doc_id") -> OrdinalModel:
    """Fit on at most max_rows rated rows, those of the smallest hashed ids; features of these rows alone reach the driver.

    Grades count from 0 to grades - 1. Rows without a grade take no part, null text is empty. With no rows, or one grade, the model is flat in the words.
    """
    chosen = bounded_batches(rated).where(F.col(grade_col).isNotNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(grade_col).cast("int").alias("grade"), F.xxhash64(F.col(id_col), F.lit(7)).alias("order"))
    chosen = chosen.orderBy("order", "text").limit(max_rows)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Features(bits)
        for some in (part for batch in batches for part in slices(batch, 0, HELD)):
            yield pa.RecordBatch.from_arrays([some.column(1), pa.array([features(x, cache) for x in some.column(0).to_pylist()], pa.list_(pa.int32()))], ["grade", "x"])

    table = chosen.repartition(16, "order").mapInArrow(described, "grade int, x array<int>").toArrow()
    grade = table["grade"].to_numpy()
    flat, sizes = table["x"].combine_chunks(), np.diff(table["x"].combine_chunks().offsets.to_numpy())
    return _descend(grade, flat.flatten().to_numpy(), sizes, grades, bits, penalty, steps)


def _descend(grade: np.ndarray, x: np.ndarray, sizes: np.ndarray, grades: int, bits: int, penalty: float, steps: int) -> OrdinalModel:
    """L-BFGS on the mean log-likelihood with an L2 penalty on weights; gaps between thresholds stay positive as exponentials."""
    n = len(grade)
    row = np.repeat(np.arange(n), sizes)
    # Features of a few rows say nothing general, and those of many rows are the language's, not a grade's.
    held = np.bincount(x, minlength=1 << bits)
    live = np.flatnonzero((held >= min(5, n)) & (held <= max(0.1 * n, 5)))
    wide, column = len(live), np.full(1 << bits, -1)
    column[live] = np.arange(wide)
    row, x = row[column[x] >= 0], column[x][column[x] >= 0]
    at = np.arange(n)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    theta_of = lambda cut: np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, cut = v[:wide], v[wide:]
        above = np.column_stack([np.ones(n), sigmoid(np.bincount(row, w[x], n)[:, None] - theta_of(cut)), np.zeros(n)])
        hi, lo = above[at, grade], above[at, grade + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p / n, lo * (1 - lo) / p / n
        d_theta = np.array([d_hi[grade == k + 1].sum() - d_lo[grade == k].sum() for k in range(grades - 1)])
        tail = np.cumsum(d_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(x, (d_lo - d_hi)[row], wide) + penalty * w, tail[:1], tail[1:] * np.exp(cut[1:])])
        return -np.log(p).mean() + penalty / 2 * (w @ w), grad

    v = np.concatenate([np.zeros(wide), [-1.0], np.zeros(max(grades - 2, 0))])
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    value, grad = loss(v) if n else (0.0, np.zeros_like(v))
    for _ in range(steps):
        if np.abs(grad).max() < 1e-6:
            break
        q, used = grad.copy(), []
        for s, y, r in reversed(past):
            used.append(r * (s @ q))
            q -= used[-1] * y
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1.0
        for (s, y, r), k in zip(past, reversed(used), strict=True):
            q += (k - r * (y @ q)) * s
        step, slope = 1.0, grad @ q
        while step > 1e-8 and (new := loss(v - step * q))[0] > value - 1e-4 * step * slope:
            step /= 2
        if step <= 1e-8:
            break
        s, y = -step * q, new[1] - grad
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y, 1 / (s @ y))]
        v, (value, grad) = v + s, new
    weights = np.zeros(1 << bits, np.float32)
    weights[live] = v[:wide]
    return OrdinalModel(weights, theta_of(v[wide:]), bits)


@lru_cache(maxsize=1)
def _words(bits: int) -> _Features:
    """Once per worker."""
    return _Features(bits)


def grader(model: OrdinalModel, keep_from: int) -> Callable[..., Column]:
    """A function of a text column: struct of expected_grade and tail_probability (of a grade of keep_from or more), by the whole text; null text is empty and gets what the thresholds alone say."""
    weights, thresholds, bits = model.weights, model.thresholds, model.bits

    @F.arrow_udf("expected_grade double, tail_probability double")
    def graded(column: pa.Array) -> pa.Array:
        cache, z = _words(bits), []
        for some in slices(pa.RecordBatch.from_arrays([column], ["text"]), 0, HELD):
            z += [weights[features(x or "", cache)].sum(dtype=np.float64) for x in some.column(0).to_pylist()]
        above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - np.array(z, np.float64)[:, None], -700, 700)))
        return pa.StructArray.from_arrays([pa.array(above.sum(1)), pa.array(above[:, keep_from - 1])], ["expected_grade", "tail_probability"])

    return graded


def score(docs: DataFrame, model: OrdinalModel, keep_from: int, least_chance: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with expected_grade, tail_probability (of a grade of keep_from or more) and kept (that it is least_chance or more). Columns of these three names are replaced; only the text goes to Python."""
    names = ["expected_grade", "tail_probability", "kept"]
    docs = docs.drop(*names)
    told = unused(docs, "told")
    graded = bounded_batches(docs).withColumn(told, grader(model, keep_from)(F.col(text_col).cast("string")))
    return graded.select(*docs.columns, *(F.col(told)[n].alias(n) for n in names[:2]), (F.col(told)["tail_probability"] >= least_chance).alias("kept"))


def keep(docs: DataFrame, model: OrdinalModel, keep_from: int, least_chance: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose chance of a grade of keep_from or more is least_chance or more."""
    return bounded_batches(docs).where(grader(model, keep_from)(F.col(text_col).cast("string"))["tail_probability"] >= least_chance)


#: Grades of the ratings at hand: toxic text, poor text, good text.
GRADES = 3


def rated(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """The texts of at most max_rows labelled documents with a grade: 0 toxic, 1 of low quality, 2 good. The chosen labels are few by that bound and are broadcast.

    Labels whose document isn't there, or with a null, are left out; of several labels of one document the lowest grade counts.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    few = labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy("doc_id").agg(F.min(grade).alias("grade")).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
