"""Embedding stand-in and reduction, boosted voters and their search, stacking and calibration."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, Normalizer, PCA, PCAModel, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from . import boosting, metrics
from .boosting import Trees, probability
from .rows import met
from .splits import early_stop, stratified_folds
from .stages import stage

# The search grid of the boosted trees, most trees, rounds without gain before they stop, width after the reduction.
GRID = {
    "max_depth": [3, 4, 5],
    "learning_rate": [0.01, 0.05, 0.1],
    "subsample": [0.7, 0.8, 1.0],
    "colsample_bytree": [0.7, 0.8, 1.0],
    "min_child_weight": [5, 10, 20],
    "gamma": [0.3, 0.5, 1.0],
    "reg_alpha": [0.1, 1.0, 5.0],
    "reg_lambda": [2.0, 5.0, 10.0],
}
MOST_TREES, PATIENCE, REDUCED = 1000, 100, 128
#: Rows whose refits go over the table at once; terms of the series of the others' sums, and how far a refit may move a row's log-odds for them.
EXACT_ROWS, ORDER, REACH = 20_000, 12, 0.25
#: Share of a fit's rows that tell when to stop; fits of the search that are in flight at once where each is itself spread over tasks.
STOP_SHARE, IN_FLIGHT = 0.15, 4


def pooled(tokens: DataFrame, id_col: str, vector_col: str, mask_col: str) -> DataFrame:
    """(id, pooled): the mean of the vectors whose mask is not 0, by component; without any, the sum over the least number, 1e-9."""
    parts = tokens.select(id_col, mask_col, F.posexplode(vector_col).alias("i", "x"))
    m = F.col(mask_col).cast("double")
    means = parts.groupBy(id_col, "i").agg((F.sum(F.col("x").cast("double") * m) / F.greatest(F.sum(m), F.lit(1e-9))).alias("x"))
    return means.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("pooled"))


def joined_channels(one: Column, two: Column) -> Column:
    return F.concat(one, two)


def embedded(rows: DataFrame, text_col: str, dim: int = 256, out: str = "embedding") -> DataFrame:
    """A deterministic stand-in for a transformer's mean-pooled vectors: hashed words and word pairs, of length 1. Swap in predict_batch_udf with a real model where one is at hand."""
    text = rows.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    words = RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\W+").transform(text)
    words = NGram(n=2, inputCol="_w", outputCol="_2").transform(words).withColumn("_all", F.concat("_w", "_2"))
    hashed = HashingTF(numFeatures=dim, inputCol="_all", outputCol="_h").transform(words)
    normed = Normalizer(inputCol="_h", outputCol="_n").transform(hashed)
    return normed.withColumn(out, vector_to_array("_n")).drop("_t", "_w", "_2", "_all", "_h", "_n")


def reducer(train: DataFrame, vector_col: str, k: int = REDUCED) -> PCAModel | None:
    """Principal components of the training rows, at most as many as the vectors have; validation and test rows are only transformed. None of fewer than two rows."""
    given = train.where(F.col(vector_col).isNotNull()).select(array_to_vector(vector_col).alias("_v"))
    some = given.take(2)
    return PCA(k=min(k, len(some[0]["_v"])), inputCol="_v", outputCol="_r").fit(given) if len(some) > 1 else None


def reduced(rows: DataFrame, model: PCAModel | None, vector_col: str, out: str = "reduced") -> DataFrame:
    """rows with the vector's components; without a model the vector as it is, null stays null."""
    if model is None:
        return rows.withColumn(out, F.col(vector_col).cast("array<double>"))
    done = model.transform(rows.withColumn("_v", array_to_vector(F.coalesce(F.col(vector_col).cast("array<double>"), F.array_repeat(F.lit(0.0), model.pc.numRows)))))
    return done.withColumn(out, F.when(F.col(vector_col).isNotNull(), vector_to_array("_r"))).drop("_v", "_r")


def assembled(rows: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Feature columns in their order as a vector of 32-bit values; missing ones are 0."""
    narrow = rows.na.fill(0, columns).withColumns({c: F.col(c).cast("float") for c in columns})
    return VectorAssembler(inputCols=columns, outputCol=out).transform(narrow)


def scale_of(rows: DataFrame, label_col: str) -> float:
    """What a positive weighs: negatives / positives, 1 if a class is missing."""
    return float(metrics.class_stats(rows, label_col).first()["scale_pos_weight"]) or 1.0


def _weight(label_col: str, scale: float) -> Column:
    return F.when(F.col(label_col) == 1, F.lit(scale)).otherwise(F.lit(1.0))


def boosted(train: DataFrame, label_col: str, id_col: str, features_col: str = "features", trees: int = 20, params: dict | None = None) -> Trees:
    """So many trees of depth 4, step 0.05 and a fixed seed, unless params, by the grid's names, say otherwise. Positives weigh negatives / positives."""
    return boosting.fit(train, label_col, id_col, features_col, _weight(label_col, scale_of(train, label_col)), F.lit(False), trees, PATIENCE, params or {})


def boosted_early(rows: DataFrame, label_col: str, id_col: str, validation_col: str, features_col: str = "features", trees: int = MOST_TREES, patience: int = PATIENCE, params: dict | None = None) -> Trees:
    """Trees of the rows that aren't marked for validation, as many as the marked ones' loss bears out: growing ends when `patience` trees in a row bring no smaller one."""
    scale = scale_of(rows.where(~F.col(validation_col)), label_col)
    return boosting.fit(rows, label_col, id_col, features_col, _weight(label_col, scale), F.col(validation_col), trees, patience, params or {})


def drawn(n: int = 20, seed: int = 42) -> list[dict]:
    """n random draws from the grid, each parameter by itself."""
    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in GRID.items()} for _ in range(n)]


def _stops(y: np.ndarray, order: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """splits.early_stop() of the rows inside, on columns: the last STOP_SHARE of each class in the order of digests."""
    out = np.zeros(len(y), bool)
    for label in np.unique(y[inside]):
        rows = np.flatnonzero(inside & (y == label))
        rows = rows[np.argsort(order[rows], kind="stable")]
        out[rows[len(rows) - int(np.ceil(len(rows) * STOP_SHARE)) :]] = True
    return out


def auc_of(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve, ties half; one half if a class is missing."""
    pos, neg = int((y == 1).sum()), int((y != 1).sum())
    if not pos or not neg:
        return 0.5
    _, place, count = np.unique(score, return_inverse=True, return_counts=True)
    ends = np.cumsum(count)
    rank = (ends - (count - 1) / 2.0)[place]
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / pos / neg)


def folded(train: DataFrame, label_col: str, id_col: str, features: list[str], folds: int = 5) -> DataFrame:
    """train with its fold and its place in its class's order of digests, written once for all fits over it."""
    return stage(stratified_folds(train.select(id_col, label_col, *features), label_col, id_col, folds, place_col="_order"), "folds")


def _binned(rows: DataFrame, label_col: str, id_col: str, features_col: str) -> tuple[DataFrame, list[np.ndarray]]:
    cuts = boosting.quantile_cuts(rows, features_col)
    return stage(boosting.binned(rows, cuts, features_col, label_col, id_col, F.lit(1.0), F.lit(False), "fold", F.col("_order").alias("order")), "binned"), cuts


def _at_once(work: list, most: int) -> list:
    """Results of functions that run Spark jobs, in order, `most` in flight at once; the first error is raised."""
    out, errors, left = [None] * len(work), [], iter(enumerate(work))

    def run() -> None:
        for i, f in left_locked():
            try:
                out[i] = f()
            except Exception as error:  # noqa: BLE001
                errors.append(error)
                return

    lock = Lock()

    def left_locked():
        while not errors:
            with lock:
                found = next(left, None)
            if found is None:
                return
            yield found

    threads = [InheritableThread(target=run) for _ in range(min(most, len(work)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if errors:
        raise errors[0]
    return out


def tuned(train: DataFrame, label_col: str, id_col: str, draws: list[dict], features_col: str = "features", trees: int = MOST_TREES, patience: int = PATIENCE, folds: int = 5, in_flight: int = IN_FLIGHT) -> tuple[dict, int, float]:
    """(parameters, number of trees, mean AUC) of the draw with the best mean AUC over folds, the first of equal ones.

    Every (draw, fold) is a fit of its own on rows that are written and binned once; bins are quantiles of all rows. Where the bins fit a task, each fit is one Spark task and all are in flight together; where they don't, the fits are
    spread over tasks themselves, and `in_flight` of them run at once. Both give the same trees. Positives weigh what they do in train as a whole.
    """
    rows = folded(train, label_col, id_col, [features_col], folds)
    table, cuts = _binned(rows, label_col, id_col, features_col)
    m, scale = boosting.held(table, len(cuts)), scale_of(rows, label_col)
    pairs = [(params, k) for params in draws for k in range(folds)]
    if m is not None:

        def fit(params: dict, k: int):
            def work(m: boosting.Matrix, cuts: list[np.ndarray]) -> str:
                keep = m.more["fold"] != k
                model = boosting.fit_held(m, _stops(m.y, m.more["order"], keep), keep, np.where(m.y == 1, scale, 1.0), cuts, trees, patience, params)
                return json.dumps([auc_of(m.y[~keep], m.margin(model, cuts, ~keep)), len(model)])

            return work

        got = boosting.in_tasks(train.sparkSession, m, cuts, [fit(*x) for x in pairs], json.loads)
    else:

        def spread(params: dict, k: int):
            def work() -> tuple[float, int]:
                model = boosted_early_scaled(rows.where(F.col("fold") != k), label_col, id_col, features_col, scale, cuts, trees, patience, params)
                scores = probability(model, rows.where(F.col("fold") == k), "p", features_col)
                found = metrics.curves(scores, label_col, "p").first()["roc_auc"]
                return 0.5 if found is None else found, len(model)

            return work

        got = _at_once([spread(*x) for x in pairs], in_flight)
    best = None
    for i, params in enumerate(draws):
        mine = got[i * folds : (i + 1) * folds]
        mean = float(np.mean([a for a, _ in mine]))
        if best is None or mean > best[2]:
            best = params, max(1, round(float(np.mean([n for _, n in mine])))), mean
    return best


def boosted_early_scaled(fit: DataFrame, label_col: str, id_col: str, features_col: str, scale: float, cuts: list[np.ndarray], trees: int, patience: int, params: dict, seed: int = 42) -> Trees:
    """The fit of one draw and fold where rows are spread: cuts and the positives' weight are given, and the rows that tell when to stop are the last of each class."""
    marked = early_stop(fit, label_col, id_col, STOP_SHARE)
    table = stage(boosting.binned(marked, cuts, features_col, label_col, id_col, _weight(label_col, scale), F.col("is_validation")), "binned")
    return boosting.fit_spread(table, cuts, trees, patience, params, seed)


def out_of_fold(train: DataFrame, label_col: str, id_col: str, voters: dict[str, str], trees: int = MOST_TREES, patience: int = PATIENCE, folds: int = 5, params: dict[str, dict] | None = None) -> DataFrame:
    """(id, label, one probability a voter): each fold is scored by models of the others, which stop early on rows of their own. All voters and folds are fitted as tuned() fits."""
    rows, models = folded(train, label_col, id_col, list(voters.values()), folds), {}
    for name, features_col in voters.items():
        given, (table, cuts) = (params or {}).get(name) or {}, _binned(rows, label_col, id_col, features_col)
        m = boosting.held(table, len(cuts))
        if m is not None:

            def fit(k: int, given: dict = given):
                def work(m: boosting.Matrix, cuts: list[np.ndarray]) -> str:
                    keep = m.more["fold"] != k
                    own = keep & ~(stop := _stops(m.y, m.more["order"], keep))
                    scale = float((own & (m.y != 1)).sum() / max((own & (m.y == 1)).sum(), 1)) or 1.0
                    return boosting.fit_held(m, stop, keep, np.where(m.y == 1, scale, 1.0), cuts, trees, patience, given, 42 + k).to_json()

                return work

            models[name] = boosting.in_tasks(train.sparkSession, m, cuts, [fit(k) for k in range(folds)], Trees.from_json)
        else:

            def spread(k: int, features_col: str = features_col, cuts: list = cuts, given: dict = given):
                fit = rows.where(F.col("fold") != k)
                own = early_stop(fit, label_col, id_col, STOP_SHARE).where("not is_validation")
                return lambda: boosted_early_scaled(fit, label_col, id_col, features_col, scale_of(own, label_col), cuts, trees, patience, given, 42 + k)

            models[name] = _at_once([spread(k) for k in range(folds)], IN_FLIGHT)
    for name, features_col in voters.items():
        rows = boosting.probability_by(models[name], rows, name, features_col, "fold")
    return stage(rows.select(id_col, label_col, *voters), "oof")


def _balanced(rows: DataFrame, label_col: str, balanced: bool) -> DataFrame:
    """rows with weight: each class n / (2 * its size), or 1."""
    if not balanced:
        return rows.withColumn("weight", F.lit(1.0))
    count = metrics.class_stats(rows, label_col).first()
    pos, neg = count["positives"], count["negatives"]
    return rows.withColumn("weight", F.when(F.col(label_col) == 1, (pos + neg) / (2.0 * max(pos, 1))).otherwise((pos + neg) / (2.0 * max(neg, 1))))


def logistic(rows: DataFrame, label_col: str, inputs: list[str], balanced: bool = True, c: float = 1.0) -> LogisticRegressionModel:
    """Logistic regression with an L2 penalty of strength 1 / c over the whole sum, balanced class weights if asked. Of no rows a model that gives one half."""
    rows = _balanced(rows, label_col, balanced)
    total = rows.agg(F.sum("weight")).first()[0]
    if not total:  # two rows that tell nothing
        rows, total = rows.sparkSession.createDataFrame([(y, 1.0, *(0.0 for _ in inputs)) for y in (0, 1)], f"`{label_col}` int, weight double, " + ", ".join(f"`{x}` double" for x in inputs)), 2.0
    given = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows.withColumn("_y", F.col(label_col).cast("double")).select("_y", "weight", *inputs))
    return LogisticRegression(labelCol="_y", weightCol="weight", maxIter=1000, tol=1e-9, regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, family="binomial").fit(given)


def calibrator(val: DataFrame, label_col: str, score_col: str) -> LogisticRegressionModel:
    """Platt scaling on the probability itself, all but without penalty."""
    return logistic(val, label_col, [score_col], balanced=False, c=1e10)


def _margin(model: LogisticRegressionModel, *inputs: str) -> Column:
    z = F.lit(float(model.intercept))
    for w, name in zip(model.coefficients.toArray().tolist(), inputs, strict=True):
        z = z + F.lit(w) * F.col(name)
    return z


def logistic_score(model: LogisticRegressionModel, *inputs: str) -> Column:
    """The model's probability as an expression."""
    return 1 / (1 + F.exp(-_margin(model, *inputs)))


def _shares(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chances of -z and of z."""
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(z)), 1 / (1 + np.exp(-z))


def _slopes(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Derivatives of the logistic function, of order 0 to ORDER, by its value p and q = 1 - p: multiples of pq, so that small ones are right too."""
    out, poly = [p], np.polynomial.Polynomial([1.0])
    for _ in range(ORDER):
        out.append(p * q * poly(p))
        poly = poly * np.polynomial.Polynomial([1.0, -2.0]) + np.polynomial.Polynomial([0.0, 1.0, -1.0]) * poly.deriv()
    return np.stack(out)


def _powers(k: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents of the products of k factors that have this degree."""
    return [(degree,)] if k == 1 else [(i, *rest) for i in range(degree, -1, -1) for rest in _powers(k - 1, degree - i)]


def _products(x: np.ndarray, powers: list[tuple[int, ...]]) -> np.ndarray:
    """(rows, products): each row's product of its columns to the powers."""
    up = x[..., None] ** np.arange(max(map(max, powers)) + 1)
    out = np.ones((len(x), len(powers)))
    for i, column in enumerate(zip(*powers, strict=True)):
        out *= up[:, i, list(column)]
    return out


def _moments(given: DataFrame, begin: np.ndarray) -> np.ndarray:
    """(2, ORDER + 1, products): by class the sums of each derivative at the coefficients, times each product of a row's columns; one pass, whose sums are as many at any number of rows."""
    k, powers = len(begin), [e for d in range(ORDER + 2) for e in _powers(len(begin), d)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, ORDER + 1, len(powers)))
        for batch in batches:
            if batch.num_rows:
                y, x = _rows_of(batch, k)
                for label in (0, 1):
                    own = x[(y == 1) == label]
                    q, p = _shares(own @ begin)
                    total[label] += _slopes(p, q) @ _products(own, powers)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    got = given.mapInArrow(summed, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow().sort_by("at")
    return got.column("v").to_numpy().reshape(2, ORDER + 1, -1) if got.num_rows else np.zeros((2, ORDER + 1, len(powers)))


def _rows_of(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels, and a line of a one and the inputs for each row."""
    y, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    return y, np.stack([np.ones(len(y)), *columns[: k - 1]], 1)


def _series(moments: np.ndarray, k: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """(powers, (2, powers, k + k k)): by class, what a product of a change of coefficients adds to the sums of p x and of pq x x after it."""
    at = {e: i for i, e in enumerate(e for d in range(ORDER + 2) for e in _powers(k, d))}
    powers = [e for d in range(ORDER + 1) for e in _powers(k, d)]
    out, more = np.zeros((2, len(powers), k + k * k)), lambda e, *to: tuple(n + to.count(i) for i, n in enumerate(e))
    for row, e in enumerate(powers):
        worth, m = 1.0 / math.prod(map(math.factorial, e)), sum(e)
        for i in range(k):
            out[:, row, i] = moments[:, m, at[more(e, i)]] * worth
            for j in range(k) if m < ORDER else ():
                out[:, row, k + i * k + j] = moments[:, m + 1, at[more(e, i, j)]] * worth
    return powers, out


def _class_weights(n: dict[int, int], y: np.ndarray, balanced: bool) -> np.ndarray:
    """(rows, 2): what a negative and a positive weigh where one row of label y is left out."""
    left = np.stack([n[0] - (y != 1), n[1] - (y == 1)], 1)
    return left.sum(1, keepdims=True) / (2.0 * np.maximum(left, 1)) if balanced else np.ones((len(y), 2))


def _ridge(k: int, c: float) -> np.ndarray:
    return np.diag([1e-12] + [1.0 / c] * (k - 1))


def _near_refits(y: np.ndarray, x: np.ndarray, begin: np.ndarray, series: tuple[list, np.ndarray], known: np.ndarray, n: dict[int, int], widest: np.ndarray, balanced: bool, c: float) -> np.ndarray:
    """Scores of rows under the models without them, by Newton's steps on the sums' series about the whole model; nan where a model is out of REACH. known: sums of x by class."""
    (powers, by_class), k, weights = series, len(begin), _class_weights(n, y, balanced)
    own, delta, out = weights[np.arange(len(y)), (y == 1).astype(int)], np.zeros((len(y), len(begin))), np.full(len(y), np.nan)
    todo = np.arange(len(y))
    for _ in range(30):
        w, rows, beta = weights[todo], x[todo], begin + delta[todo]
        products = _products(delta[todo], powers)
        sums = w[:, :1] * (products @ by_class[0]) + w[:, 1:] * (products @ by_class[1])
        p = _shares((beta * rows).sum(1))[1]
        slope = sums[:, :k] - w[:, 1:] * known - (own[todo] * (p - y[todo]))[:, None] * rows + beta @ _ridge(k, c)
        curve = sums[:, k:].reshape(-1, k, k) - (own[todo] * p * (1 - p))[:, None, None] * rows[:, :, None] * rows[:, None, :] + _ridge(k, c)
        fine = np.linalg.cond(curve) < 1e15
        step = np.zeros_like(slope)
        step[fine] = np.linalg.solve(curve[fine], slope[fine][..., None])[..., 0]
        delta[todo] -= step
        far = ~fine | ~(np.abs(delta[todo]) @ widest <= REACH)
        done = ~far & (np.abs(step) @ widest < 1e-12)
        out[todo[done]] = _shares(((begin + delta[todo[done]]) * x[todo[done]]).sum(1))[1]
        todo = todo[~far & ~done]
        if not len(todo):
            break
    return out


def _far_refits(given: DataFrame, y: np.ndarray, x: np.ndarray, begin: np.ndarray, n: dict[int, int], balanced: bool, c: float) -> np.ndarray:
    """Scores of a few rows (y, x) under the models without them: Newton's steps, halved where the loss would grow, on sums over the whole table, a pass a step."""
    k, weights, ridge = len(begin), _class_weights(n, y, balanced), _ridge(len(begin), c)
    pairs, own = [(i, j) for i in range(k) for j in range(i, k)], weights[np.arange(len(y)), (y == 1).astype(int)]
    beta, best, step = np.tile(begin, (len(y), 1)), np.full(len(y), np.inf), np.zeros((len(y), k))
    todo = np.arange(len(y))
    for _ in range(200):
        tried, w = beta[todo] - step[todo], weights[todo]

        def summed(batches: Iterator[pa.RecordBatch], tried: np.ndarray = tried, w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total, size = np.zeros((len(tried), 1 + k + len(pairs))), max(1, (1 << 20) // len(tried))
            for batch in batches:
                all_y, all_x = _rows_of(batch, k) if batch.num_rows else (np.zeros(0), np.zeros((0, k)))
                for a in range(0, len(all_y), size):
                    part, sign = all_x[a : a + size], np.where(all_y[a : a + size] == 1, 1.0, -1.0)
                    weight, z = w[:, (sign > 0).astype(int)], (tried @ part.T) * sign
                    p, q = _shares(z)
                    total[:, 0] += (weight * np.logaddexp(0, -z)).sum(1)
                    total[:, 1 : 1 + k] -= (weight * p * sign) @ part
                    total[:, 1 + k :] += (weight * p * q) @ np.stack([part[:, i] * part[:, j] for i, j in pairs], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

        got = given.mapInArrow(summed, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow().sort_by("at").column("v").to_numpy().reshape(len(todo), -1)
        rows, sign = x[todo], np.where(y[todo] == 1, 1.0, -1.0)
        z = (tried * rows).sum(1) * sign
        p, q = _shares(z)
        loss = got[:, 0] - own[todo] * np.logaddexp(0, -z) + ((tried @ ridge) * tried).sum(1) / 2
        slope = got[:, 1 : 1 + k] + (own[todo] * p * sign)[:, None] * rows + tried @ ridge
        curve = np.empty((len(todo), k, k))
        for at, (i, j) in enumerate(pairs):
            curve[:, i, j] = curve[:, j, i] = got[:, 1 + k + at] - own[todo] * p * q * rows[:, i] * rows[:, j] + ridge[i, j]
        better = loss <= best[todo] + 1e-12 * np.abs(loss)
        beta[todo[better]], best[todo[better]] = tried[better], loss[better]
        new = (np.linalg.pinv(curve, hermitian=True) @ slope[..., None])[..., 0]
        small = np.abs(step[todo]).max(1) < 1e-10 * (1 + np.abs(beta[todo]).max(1))  # halved to nothing
        step[todo] = np.where(better[:, None], new, step[todo] / 2)
        todo = todo[np.where(better, np.abs(new).max(1) >= 1e-10 * (1 + np.abs(tried).max(1)), ~small)]
        if not len(todo):
            break
    return _shares((beta * x).sum(1))[1]


def left_out(rows: DataFrame, model: LogisticRegressionModel, label_col: str, inputs: list[str], balanced: bool = True, c: float = 1.0, out: str = "loo_score", most: int = EXACT_ROWS) -> DataFrame:
    """Each row's probability under the model refitted without it, class weights included, at any number of rows. Of an empty table no rows. model: of logistic(), with the same c and weights.

    A refit needs sums over all rows at its own coefficients. These are near the whole model's, about which the sums are a power series: ORDER of its terms, one pass over the table, give the refits of all rows that move no row's log-odds by more than
    REACH, to some ten digits. The other refits, of rows that weigh much, go over the table themselves, `most` at once and a pass a step; equal rows share one.
    """
    given = stage(rows.select("*", F.col(label_col).cast("double").alias("_y"), *(F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(inputs))), "loo")
    names, begin = [f"_x{i}" for i in range(len(inputs))], np.array([model.intercept, *model.coefficients.toArray()])
    data, is_pos = given.select("_y", *names), F.col("_y") == 1
    told = given.agg(F.count_if(is_pos).alias("n1"), F.count_if(~is_pos).alias("n0"), *(F.max(F.abs(x)).alias(f"w{x}") for x in names), *(F.sum(F.when(is_pos, F.col(x))).alias(f"s{x}") for x in names)).first()
    n, widest = {0: told["n0"], 1: told["n1"]}, np.array([1.0, *(told[f"w{x}"] or 0.0 for x in names)])
    known = np.array([float(n[1]), *(told[f"s{x}"] or 0.0 for x in names)])
    series = _series(_moments(data, begin), len(begin))

    @F.arrow_udf("double")
    def refitted(y: pa.Array, *x: pa.Array) -> pa.Array:
        own = np.stack([np.ones(len(y)), *(v.to_numpy() for v in x)], 1)
        parts = [_near_refits(y.to_numpy()[a : a + 2048], own[a : a + 2048], begin, series, known, n, widest, balanced, c) for a in range(0, len(y), 2048)]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64(), from_pandas=True)

    near = stage(given.withColumn(out, refitted("_y", *names)), "loo")
    far = stage(near.where(F.col(out).isNull()).select("_y", *names).distinct(), "far")
    if far.isEmpty():
        return near.select(*rows.columns, out)
    parts, waiting = [], far.toLocalIterator()
    while some := list(islice(waiting, most)):
        table = np.array(some)
        scores = _far_refits(data, table[:, 0], np.column_stack([np.ones(len(table)), table[:, 1:]]), begin, n, balanced, c)
        parts.append(stage(rows.sparkSession.createDataFrame(pa.table([*(pa.array(v) for v in table.T), pa.array(scores)], ["_y", *names, "_far"])), "far"))
    done = met(near, reduce(DataFrame.unionByName, parts), ["_y", *names], "left")
    return stage(done.withColumn(out, F.coalesce(out, "_far")).select(*rows.columns, out), "loo")
