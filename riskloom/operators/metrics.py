"""Evaluation of scores against 0/1 labels, exact with ties, without one task that holds all scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Score ranges in which running sums are kept.
RANGES = 64


def class_stats(rows: DataFrame, label_col: str) -> DataFrame:
    """(n, positives, negatives, scale_pos_weight)."""
    y = F.col(label_col)
    pos, neg = F.count_if(y == 1), F.count_if(y == 0)
    return rows.agg(F.count("*").alias("n"), pos.alias("positives"), neg.alias("negatives"), (neg / F.greatest(pos, F.lit(1))).alias("scale_pos_weight"))


def confusion(rows: DataFrame, label_col: str, score_col: str, threshold: float = 0.5) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall, f1); a ratio over nothing is 0."""
    y, p = F.col(label_col) == 1, F.col(score_col) >= threshold
    c = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _curve(rows: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """(score, pos, neg, pos_above, neg_above) by distinct score; running sums run in ranges of the score, over the ranges' totals."""
    by = rows.groupBy(F.col(score_col).cast("double").alias("score")).agg(F.count_if(F.col(label_col) == 1).alias("pos"), F.count_if(F.col(label_col) == 0).alias("neg"))
    cuts = sorted(set(by.approxQuantile("score", [i / RANGES for i in range(1, RANGES)], 0.01)))
    ranged = by.withColumn("r", sum((F.col("score") >= c).cast("int") for c in cuts) if cuts else F.lit(0))
    totals = ranged.groupBy("r").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("r", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c, base: (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(base))
    return ranged.join(F.broadcast(bases), "r").select("score", "pos", "neg", run("pos", "p0").alias("pos_above"), run("neg", "n0").alias("neg_above"))


def curves(rows: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """(roc_auc, average_precision): ties count half in the first; the second is the step sum over distinct scores. Null where a class is missing."""
    c = _curve(rows, label_col, score_col)
    wins = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0))
    seen = F.col("pos_above") + F.col("pos")
    steps = F.sum(F.col("pos") * seen / (seen + F.col("neg_above") + F.col("neg")))
    return c.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"), F.try_divide(steps, F.sum("pos")).alias("average_precision"))


def model_stats(rows: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """Curves and the confusion at one half, in one row."""
    one = curves(rows, label_col, score_col).withColumn("_one", F.lit(1))
    return one.join(confusion(rows, label_col, score_col).withColumn("_one", F.lit(1)), "_one").drop("_one")


def warnings(meta_loo_auc: float, meta_val_auc: float, cal_loo_auc: float, cal_val_auc: float, test_auc: float) -> list[str]:
    """Which generalisation gaps are over their limits."""
    out = ["leave-one-out above validation"] if meta_loo_auc - meta_val_auc > 0.03 else []
    out += ["calibration unstable"] if abs(cal_loo_auc - cal_val_auc) > 0.02 else []
    return out + (["test below validation"] if cal_val_auc - test_auc > 0.03 else [])
