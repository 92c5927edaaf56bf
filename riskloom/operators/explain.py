"""Attributions: Shapley values of boosted trees' margin along their paths, and the blend's contributions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from .boosting import Trees, features_array


#: Features of a path up to which parts are worked out for all sets of them.
TOLD = 8


@dataclass(frozen=True)
class Paths:
    """Leaves of one tree: of each its value, and for each of its path's distinct features, the range that leads there and the share of rows that fall in. Shorter paths are filled with feature -1, which all rows meet.

    told: (sets of a path's features, leaves, features), what each feature adds where a row is inside the ranges of just that set; none of paths of more than TOLD features.
    """

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    told: np.ndarray | None = None


def paths(model: Trees) -> list[Paths]:
    out = []
    for root in model.roots.tolist():
        found, todo = [], [(root, {})]
        while todo:
            node, path = todo.pop()
            f = int(model.feature[node])
            if f < 0:
                found.append((float(model.value[node]), path))
                continue
            for child, low, high in ((int(model.left[node]), -np.inf, float(model.cut[node])), (int(model.right[node]), float(model.cut[node]), np.inf)):
                a, b, share = path.get(f, (-np.inf, np.inf, 1.0))
                todo.append((child, path | {f: (max(a, low), min(b, high), share * float(model.cover[child] / model.cover[node]))}))
        width = max(1, *(len(path) for _, path in found))
        cells = np.full((4, len(found), width), 0.0)
        cells[0], cells[1], cells[2], cells[3] = -1, -np.inf, np.inf, 1.0
        for i, (_, path) in enumerate(found):
            for j, (f, (low, high, share)) in enumerate(path.items()):
                cells[:, i, j] = f, low, high, share
        one = Paths(np.array([v for v, _ in found]), cells[0].astype(np.int64), *cells[1:])
        sets = np.arange(1 << min(width, TOLD))[:, None, None] >> np.arange(width) & 1
        out.append(replace(one, told=_parts(one, np.broadcast_to(sets, (len(sets), *one.share.shape)).astype(float))) if width <= TOLD else one)
    return out


def _times(poly: np.ndarray, share: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Polynomials of the number of known features, times one that is known (1 if the row is inside) or not (its share)."""
    out = poly * share
    out[..., 1:] += poly[..., :-1] * inside
    return out


def _parts(p: Paths, inside: np.ndarray) -> np.ndarray:
    """(rows, leaves, features of a path): what each adds. inside: 1 where a row is in a feature's range.

    The sum over sets of known features goes by their number: on a path of m features, polynomials of those before and of those after a feature are multiplied, some m^3 steps for all rows at once in place of 2^m sets.
    """
    m, inside, share = p.feature.shape[1], inside[..., None], p.share[None, ..., None]
    one = np.zeros((*inside.shape[:2], m + 1))
    one[..., 0] = 1.0
    before, after = [one], [one]
    for j in range(m - 1):
        before.append(_times(before[-1], share[:, :, j], inside[:, :, j]))
        after.append(_times(after[-1], share[:, :, m - 1 - j], inside[:, :, m - 1 - j]))
    worth, out = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]), np.empty(inside.shape[:3])
    for j in range(m):
        total = np.zeros(inside.shape[:2])
        for k in range(m):
            for i in range(k + 1):
                total += worth[k] * before[j][..., i] * after[m - 1 - j][..., k - i]
        out[..., j] = p.value * total * (inside[:, :, j, 0] - p.share[:, j])
    return out


def shapley(x: np.ndarray, found: list[Paths], base: float = 0.0) -> tuple[np.ndarray, float]:
    """Attributions (rows x features) and the expected margin. A feature not known follows the training rows' shares down the tree; values of at most `cut` go left. Parts are looked up by the set of ranges that a row is in."""
    out = np.zeros((len(x), x.shape[1] + 1))
    for p in found:
        base += float((p.value * p.share.prod(1)).sum())
        values = x[:, p.feature]  # rows x leaves x features; feature -1 takes any
        inside = (values > p.low) & (values <= p.high)
        if p.told is None:
            parts = _parts(p, inside.astype(float))
        else:
            parts = p.told[inside @ (1 << np.arange(inside.shape[2])), np.arange(len(p.value))]
        to = np.zeros((p.feature.size, out.shape[1]))
        to[np.arange(p.feature.size), p.feature.ravel()] = 1.0
        out += parts.reshape(len(x), -1) @ to
    return out[:, :-1], base


def tree_attributions(rows: DataFrame, model: Trees, names: list[str], id_col: str, features_col: str = "features", shown: Column | None = None) -> DataFrame:
    """(id, base, total, attributions): each feature's value, of `shown` where the model takes scaled ones, and its part of the log-odds, largest absolute part first. The paths, as many as the model has leaves, go to each task once."""
    found = rows.sparkSession.sparkContext.broadcast(paths(model))

    def explained(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if part.empty:
                continue
            x = np.stack(part["x"].to_numpy())
            phi, base = (np.concatenate(v) if i == 0 else v[0] for i, v in enumerate(zip(*(shapley(x[a : a + 512], found.value, model.base) for a in range(0, len(x), 512)), strict=True)))
            told = [
                sorted(({"feature": n, "raw_value": round(float(v), 4), "impact": round(float(p), 4)} for n, v, p in zip(names, xs, ps, strict=True)), key=lambda d: -abs(d["impact"]))
                for xs, ps in zip(part["shown"], phi, strict=True)
            ]
            yield pd.DataFrame({id_col: part[id_col], "base": base, "total": phi.sum(1) + base, "attributions": told})

    x = features_array(rows, features_col)
    given = rows.select(id_col, x.alias("x"), (x if shown is None else shown).alias("shown"))
    return given.mapInPandas(explained, f"{id_col} {dict(rows.dtypes)[id_col]}, base double, total double, attributions array<struct<feature: string, raw_value: double, impact: double>>")


def blend_contributions(model: LogisticRegressionModel, **voters: Column) -> Column:
    """Each voter's weight, probability and part of the log-odds; the intercept is no voter's."""
    weights = model.coefficients.toArray().tolist()
    return F.array(*(F.struct(F.lit(name).alias("voter"), F.round(F.lit(w), 4).alias("weight"), F.round(p, 4).alias("probability"), F.round(F.lit(w) * p, 4).alias("impact")) for w, (name, p) in zip(weights, voters.items(), strict=True)))
