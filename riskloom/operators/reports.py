"""Training end to end, scoring of pages, and the reports."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import PCAModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed, text as tx, url as ur
from ..sources import page_folder
from ..sources.pages import write_summary
from . import boosting, dedup, embedding, explain, html_features, metrics, models, splits, umap
from .boosting import Trees
from .cache import ContentCache
from .rows import keyed, met
from .stages import stage

#: Width of one channel's stand-in embedding; what a cache of descriptions goes by.
CHANNEL = 128
DESCRIBED_VERSION = f"pages-{CHANNEL}-1"


@dataclass
class Bundle:
    """All that scoring needs. A bundle that load() gives scores as the one that was saved."""

    numeric: Trees
    text: Trees
    reduction: PCAModel | umap.Reduction | None
    meta: LogisticRegressionModel
    platt: LogisticRegressionModel
    means: dict[str, tuple[float, float]]
    encoder: str | None = None

    def save(self, spark: SparkSession, path: str, about: dict | None = None) -> None:
        """Write the models below one folder, with scaling, trees and what else is told about them as JSON; what was there is replaced."""
        laid = isinstance(self.reduction, umap.Reduction)
        for name in ("meta", "platt", *(("reduction",) if self.reduction is not None and not laid else ())):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")
        if laid:
            self.reduction.save(spark, f"{path}/reduction")
        said = {"numeric": self.numeric.to_json(), "text": self.text.to_json(), "means": self.means, "reduced": "umap" if laid else "pca" if self.reduction is not None else None, "encoder": self.encoder, "about": about or {}}
        spark.createDataFrame([(json.dumps(said),)], "said string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> tuple[Bundle, dict]:
        """(bundle, what was told about it)."""
        said = json.loads(spark.read.text(f"{path}/bundle").first()[0])
        meta, platt = (LogisticRegressionModel.load(f"{path}/{name}") for name in ("meta", "platt"))
        kind = {"umap": lambda x: umap.Reduction.load(spark, x), "pca": PCAModel.load, None: lambda _: None}[said["reduced"]]
        reduction = kind(f"{path}/reduction")
        means = {k: (m, s) for k, (m, s) in said["means"].items()}
        return cls(Trees.from_json(said["numeric"]), Trees.from_json(said["text"]), reduction, meta, platt, means, said["encoder"]), said["about"]


def _described(pages: DataFrame, key: str, html_col: str, encoder: str | None = None) -> DataFrame:
    rows = met(html_features.features(pages, key, html_col), html_features.text_channels(pages, key, html_col), key)
    if encoder:
        return embedding.channels(rows, "visible_text", "structural_core", "embedding", encoder)
    both = models.embedded(models.embedded(rows, "visible_text", CHANNEL, "_a"), "structural_core", CHANNEL, "_b")
    return both.withColumn("embedding", models.joined_channels(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def described(pages: DataFrame, key: str, html_col: str, cache: ContentCache | None = None, encoder: str | None = None) -> DataFrame:
    """Numeric features, channels and the two channels' embedding of each page, by a key that is unique, written once. Null html counts as empty. With a cache, only contents that it lacks are described. encoder: the model of the embedding, "module:function"; hashed words without one."""
    if cache is None:
        return stage(_described(pages, key, html_col, encoder), "described")
    html = F.coalesce(F.col(html_col), F.lit(""))
    named = pages.select(F.col(key).alias("_page"), dedup.content_key(html).alias("key"), html.alias("html"))
    known = cache.get(named.select("key", "html"), lambda missing: _described(missing, "key", "html", encoder))
    return stage(met(named.select("_page", "key"), known, "key").drop("key").withColumnRenamed("_page", key), "described")


def ready(rows: DataFrame, bundle_means: dict[str, tuple[float, float]], reduction: PCAModel | umap.Reduction | None) -> DataFrame:
    """Scaled numeric features and the reduced embedding as the two voters' inputs."""
    scaled = rows.withColumns({f"s_{c}": (F.col(c).cast("double") - m) / s for c, (m, s) in bundle_means.items()})
    numeric = models.assembled(scaled, [f"s_{c}" for c in bundle_means], "x_numeric")
    done = umap.transform(numeric, reduction, "embedding") if isinstance(reduction, umap.Reduction) else models.reduced(numeric, reduction, "embedding")
    return done.withColumn("x_text", array_to_vector("reduced"))


def train(pages: DataFrame, id_col: str, html_col: str, label_col: str, trees: int = models.MOST_TREES, patience: int = models.PATIENCE, width: int = models.REDUCED, draws: list[dict] | None = None, cache_dir: str | None = None, encoder: str | None = None, reducer: str = "pca") -> tuple[Bundle, DataFrame, dict]:
    """(models, test rows with scores, what the training found). Copies never cross the split; scaling and reduction see train alone, the blend out-of-fold scores alone, the calibration val alone.

    draws: parameters to search for each voter over folds, which then settle its number of trees, at most `trees`; 20 of the grid unless others are given. Without any ([]) both voters have `trees` trees of the default
    parameters. width: of the reduced embedding, with principal components at most the embedding's own. Rows keep their ids, repeated and null ones too; rows without a label train nothing. Of an empty table come models without trees and no test rows.
    cache_dir: where descriptions and signatures of contents are kept, so that training over a table that has grown works out what is new. encoder: see described(); the bundle names it.
    reducer: "pca", or "umap" for the layout of near neighbours, whose training rows have to fit umap.HELD_BYTES (an error says so).
    """
    if reducer not in ("pca", "umap"):
        raise ValueError(f"no reducer {reducer!r}")
    draws = models.drawn() if draws is None else draws
    spark = pages.sparkSession
    kept = [ContentCache(spark, f"{cache_dir}/{name}", version) if cache_dir else None for name, version in (("described", f"{DESCRIBED_VERSION}-{(encoder or 'hashed').replace(':', '.')}"), ("signatures", dedup.SIGNATURE_VERSION))]
    pages, key = keyed(pages.where(F.col(label_col).isNotNull()).select(id_col, html_col, label_col), id_col, html_col, label_col)
    bodies = pages.select(key, html_col, label_col, html_features.body_of(F.col(html_col)).alias("_body"))
    groups = dedup.near_groups(bodies, key, html_col, label_col, shingled_col="_body", cache=kept[1])
    split = splits.group_split(groups, "group_id").select(key, "split")
    rows = stage(met(met(described(pages, key, html_col, kept[0], encoder), pages.select(key, *({id_col, label_col} - {key})), key), split, key), "rows")
    fit = rows.where("split = 'train'")
    stats = fit.agg(*(F.avg(c).alias(f"m_{c}") for c in fixed.FEATURES), *(F.stddev_pop(c).alias(f"s_{c}") for c in fixed.FEATURES)).first()
    means = {c: (float(stats[f"m_{c}"] or 0.0), float(stats[f"s_{c}"] or 1.0)) for c in fixed.FEATURES}
    reduction = models.reducer(fit, "embedding", width) if reducer == "pca" else umap.fit(fit, key, "embedding", width).some()
    rows = stage(ready(rows, means, reduction), "ready")
    fit, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    voters, params, sizes, aucs = {"p_numeric": "x_numeric", "p_text": "x_text"}, {}, dict.fromkeys(("p_numeric", "p_text"), trees), {}
    for name, features_col in voters.items() if draws else ():
        params[name], sizes[name], aucs[name] = models.tuned(fit, label_col, key, draws, features_col, trees, patience)
    oof = models.out_of_fold(fit, label_col, key, voters, trees, patience, params=params)
    meta = models.logistic(oof, label_col, list(voters))
    numeric, text = (models.boosted(fit, label_col, key, features_col, sizes[name], params.get(name)) for name, features_col in voters.items())
    blend = lambda part: voted(part, numeric, text, meta)
    val = stage(blend(val).select(key, label_col, "p_blend"), "val")
    platt = models.calibrator(val, label_col, "p_blend")
    test = stage(blend(rows.where("split = 'test'")).withColumn("p_final", models.logistic_score(platt, "p_blend")), "scored")
    auc = lambda part, score: metrics.curves(part, label_col, score).first()["roc_auc"]
    found = {
        "meta_oof_auc": auc(oof.withColumn("p", models.logistic_score(meta, *voters)), "p"),
        "meta_loo_auc": auc(models.left_out(oof, meta, label_col, list(voters)), "loo_score"),
        "meta_val_auc": auc(val, "p_blend"),
        "cal_val_auc": auc(val.withColumn("p", models.logistic_score(platt, "p_blend")), "p"),
        "cal_loo_auc": auc(models.left_out(val, platt, label_col, ["p_blend"], balanced=False, c=1e10), "loo_score"),
    }
    known = {k: 0.5 if x is None else x for k, x in (found | {"test_auc": auc(test, "p_final")}).items()}  # one class alone tells nothing
    found["generalisation_gap_val_test"] = known["cal_val_auc"] - known["test_auc"]
    warned = metrics.warnings(**{k: known[k] for k in ("meta_loo_auc", "meta_val_auc", "cal_loo_auc", "cal_val_auc", "test_auc")})
    count = {r[label_col]: r["n"] for r in rows.groupBy(label_col).agg(F.count("*").alias("n")).collect()}
    found |= {"warnings": warned, "n_files": sum(count.values()), "n_phishing": count.get(1, 0), "n_benign": count.get(0, 0)}
    found |= {"splits": {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}, "decision_threshold": fixed.PHISHING_FROM, "params": params, "cv_auc": aucs}
    found |= {"n_described": kept[0].computed, "n_signed": kept[1].computed} if cache_dir else {}
    found |= {"n_trees": {"p_numeric": len(numeric), "p_text": len(text)}, "reducer": reducer, "reduced_width": reduction.places.shape[1] if isinstance(reduction, umap.Reduction) else reduction.getK() if reduction else 0, "meta_lr_coef": meta.coefficients.toArray().tolist(), "meta_lr_intercept": float(meta.intercept), "numeric_columns": fixed.FEATURES}
    return Bundle(numeric, text, reduction, meta, platt, means, encoder), test, found


def train_folder(spark: SparkSession, root: str, bundle_dir: str, cache_dir: str | None = None, **settings) -> tuple[Bundle, DataFrame, dict]:
    """train() over the class folders of page files below root, whose models are saved in bundle_dir, the summary of the test rows beside them. settings: those of train()."""
    bundle, test, found = train(page_folder.read(spark, root), "ordinal", "html", "label", cache_dir=cache_dir, **settings)
    bundle.save(spark, bundle_dir, found)
    write_summary(summary(test, "label", found), f"{bundle_dir}/summary")
    return bundle, test, found


def voted(rows: DataFrame, numeric: Trees, text: Trees, meta: LogisticRegressionModel) -> DataFrame:
    both = boosting.probability(text, boosting.probability(numeric, rows, "p_numeric", "x_numeric"), "p_text", "x_text")
    return both.withColumn("p_blend", models.logistic_score(meta, "p_numeric", "p_text"))


def summary(test: DataFrame, label_col: str, found: dict | None = None) -> DataFrame:
    """One row of stats a model on the test rows, with what the training found, as JSON, beside each."""
    test, out = stage(test.select(label_col, "p_numeric", "p_text", "p_final"), "test"), None
    for name, score in (("numeric", "p_numeric"), ("text", "p_text"), ("blend", "p_final")):
        one = metrics.model_stats(test, label_col, score).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("training", F.lit(json.dumps(found))) if found else out


def scored(pages: DataFrame, bundle: Bundle, key: str, html_col: str) -> DataFrame:
    """Features, votes, the blend and what they come from, by a key that is unique."""
    rows = ready(described(pages, key, html_col, encoder=bundle.encoder), bundle.means, bundle.reduction)
    done = voted(rows, bundle.numeric, bundle.text, bundle.meta).withColumn("p_final", F.round(models.logistic_score(bundle.platt, "p_blend"), 4))
    attributed = explain.tree_attributions(done, bundle.numeric, fixed.FEATURES, key, "x_numeric", F.array(*(F.col(c).cast("double") for c in fixed.FEATURES))).select(key, "attributions")
    parts = explain.blend_contributions(bundle.meta, numeric=F.col("p_numeric"), text=F.col("p_text"))
    return met(done.withColumn("contributions", parts), attributed, key)


def _vote(score: Column) -> Column:
    return F.struct(F.round(score, 4).alias("score"), tx.verdict(score).alias("prediction"))


def scan(pages: DataFrame, bundle: Bundle, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, blend, split_a, split_b, url_risk, shap, error): a page without a URL has an error instead of a scan."""
    pages, key = keyed(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "id", "url", "html")
    given = pages.select(key, "id", ur.normalized(F.coalesce("url", F.lit(""))).alias("url"))
    both = met(given, scored(pages, bundle, key, "html"), key)
    fine = F.col("url").isNotNull()
    return both.select(
        F.col("id").alias(id_col),
        "url",
        F.when(fine, F.struct(tx.verdict(F.col("p_final")).alias("final_prediction"), F.col("p_final").alias("final_score"))).alias("blend"),
        F.when(fine, _vote(F.col("p_numeric"))).alias("split_a"),
        F.when(fine, _vote(F.col("p_text"))).alias("split_b"),
        ur.risk(F.col("url")).alias("url_risk"),
        F.when(fine, F.struct(F.col("attributions").alias("numeric_top"), F.col("contributions").alias("meta_contributions"))).alias("shap"),
        F.when(~fine, "url is required").alias("error"),
    )


def answered(requests: DataFrame, fetched: DataFrame, bundle: Bundle, report: str = "scan") -> DataFrame:
    """(request_id, status, answer): the JSON that each request, a JSON text (request_id, body) with a url, is answered with; report is "scan" or "pipeline".

    fetched: (url, final_url, html), the pages that a fetch has found, by normalized URL; of several of one URL the first by final_url and html. Status 400 for a body that is no JSON or lacks a URL, 502 for a page that isn't there,
    both with an error. Each page is scored once, however many ask for it. Repeated and null ids stay rows of their own.
    """
    asked = requests.select("request_id", ur.normalized(F.from_json(F.coalesce("body", F.lit("")), "url string")["url"]).alias("url"))
    wanted = asked.where("url is not null").select("url").distinct()
    page = F.min(F.struct("final_url", F.coalesce("html", F.lit("")).alias("html"))).alias("page")
    pages = fetched.select(ur.normalized(F.col("url")).alias("url"), "final_url", "html").join(wanted, "url", "left_semi").groupBy("url").agg(page).select("url", F.coalesce("page.final_url", "url").alias("final_url"), "page.html")
    if report == "scan":
        done = scan(pages, bundle, "url", "final_url", "html").drop("error")
        said = F.to_json(F.struct(F.col("final").alias("url"), "blend", "split_a", "split_b", "url_risk", "shap"))
        done = done.toDF("asked", "final", *done.columns[2:]).select(F.col("asked").alias("url"), said.alias("said"))
    else:
        done = pipeline_report(pages.withColumn("id", F.col("url")), bundle, "id", "url", "html", "final_url").select(F.col("id").alias("url"), F.to_json(F.struct(F.col("stages.url_analysis.final_url").alias("url"), "stages")).alias("said"))
    error = lambda text: F.to_json(F.struct(F.lit(text).alias("error")))
    status = F.when(F.col("url").isNull(), 400).when(F.col("said").isNull(), 502).otherwise(200)
    answer = F.when(F.col("url").isNull(), error("Missing 'url' field")).when(F.col("said").isNull(), error("page not fetched")).otherwise(F.col("said"))
    return met(asked, done, "url", "left").select("request_id", status.alias("status"), answer.alias("answer"))


def pipeline_report(pages: DataFrame, bundle: Bundle, id_col: str, url_col: str, html_col: str, final_url_col: str | None = None) -> DataFrame:
    """(id, url, stages): what every stage made of a page, a row a row."""
    taken = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(final_url_col or url_col).alias("final_url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    pages, key = keyed(taken, "id", "url", "final_url", "html")
    given = pages.select(key, "id", "url", "final_url", F.length("html").alias("html_bytes"), html_features.title_of("html").alias("title"))
    rows = met(given, scored(pages, bundle, key, "html"), key)
    rated = ur.risk(F.col("final_url"))
    weights = bundle.meta.coefficients.toArray().round(4).tolist()
    cut = lambda c: (F.substring(c, 1, 1500).alias(c), F.length(c).alias(f"{c}_len"))
    stages = F.struct(
        F.struct(F.col("url").alias("original_url"), "final_url", ur.redirected(F.col("url"), F.col("final_url")).alias("redirected"), rated["score"].alias("score"), rated["signals"].alias("signals")).alias("url_analysis"),
        F.struct("html_bytes", "title").alias("fetch"),
        F.struct(F.map_from_arrays(F.array(*map(F.lit, fixed.FEATURES)), F.array(*(F.round(F.col(c).cast("double"), 4) for c in fixed.FEATURES))).alias("features")).alias("html_features"),
        F.struct(*cut("visible_text"), *cut("structural_core")).alias("text_extraction"),
        F.struct(F.size("embedding").alias("raw_dims"), F.size("reduced").alias("reduced_dims")).alias("embedding"),
        F.struct(F.round("p_numeric", 4).alias("score"), tx.verdict(F.col("p_numeric")).alias("prediction"), F.col("attributions").alias("shap_top")).alias("voter_a"),
        _vote(F.col("p_text")).alias("voter_b"),
        F.struct(
            F.array(F.round("p_numeric", 4), F.round("p_text", 4)).alias("inputs"),
            F.array(*map(F.lit, weights)).alias("lr_weights"),
            F.lit(round(float(bundle.meta.intercept), 4)).alias("lr_intercept"),
            F.col("p_final").alias("calibrated_score"),
            tx.verdict(F.col("p_final")).alias("prediction"),
            F.col("contributions").alias("shap_contributions"),
        ).alias("meta"),
    )
    return rows.select(F.col("id").alias(id_col), "url", stages.alias("stages"))


def diagnose(pages: DataFrame, id_col: str, url_col: str, html_col: str, final_url_col: str | None = None, head: int = 50) -> DataFrame:
    """(id, redirected, domain_changed, challenges, parked, n_lines, head): what hints at a page that isn't the site's own; head 0 keeps all lines. Null html counts as empty; without a URL nothing tells of a redirect."""
    last, html = F.col(final_url_col or url_col), F.coalesce(F.col(html_col), F.lit(""))
    lines = F.split(html, "\r\n|\r|\n")
    return pages.select(
        id_col,
        ur.redirected(F.col(url_col), last).alias("redirected"),
        ur.domain_changed(F.col(url_col), last).alias("domain_changed"),
        tx.challenges(html).alias("challenges"),
        tx.parked(html).alias("parked"),
        F.size(lines).alias("n_lines"),
        F.array_join(F.slice(lines, 1, head) if head else lines, "\n").alias("head"),
    )
