import json

from pyspark.sql import functions as F

from riskloom.operators import models, reports
from riskloom.operators.transformer import PageFeatures
from riskloom.streaming import scoring


def test_a_stream_is_rated_like_a_table(spark, sf001, tmp_path):
    pages = spark.read.parquet(f"{sf001}/pages.parquet").where("page_id is not null")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = scoring.rated(scoring.page_stream(spark, str(tmp_path / "in"), 1))
    run = stream.writeStream.format("memory").queryName("rated").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    run.awaitTermination()
    shown = lambda df: sorted((r.page_id, r.verdict, r.url_risk.score) for r in df.collect())
    assert shown(spark.table("rated")) == shown(scoring.rated(pages))


def test_the_extractor_is_a_pipeline_stage(spark, sf001, tmp_path):
    pages = spark.read.parquet(f"{sf001}/pages.parquet")
    stage = PageFeatures(idCol="page_id", htmlCol="html")
    stage.write().overwrite().save(str(tmp_path / "stage"))
    got = PageFeatures.load(str(tmp_path / "stage")).transform(pages)
    assert {"raw_len", "visible_text", "structural_core"} <= set(got.columns)
    assert got.count() == pages.count()


def test_training_scanning_and_saving(spark, tmp_path):
    html = F.concat(F.lit("<p>"), F.sha2(F.col("doc_id").cast("string"), 256), F.repeat(F.lit("<a href='http://x.org/login'>in</a>"), (F.col("label") * 3).cast("int")), F.lit("</p>"))
    rows = spark.range(80).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label")).withColumn("html", html)
    bundle, test, found = reports.train(rows, "doc_id", "html", "label", trees=2, width=16, draws=[])
    assert found["n_trees"] == {"p_numeric": 2, "p_text": 2} and sum(found["splits"].values()) == found["n_files"] == found["n_phishing"] + found["n_benign"]
    assert all(0 <= found[k] <= 1 for k in ("meta_oof_auc", "meta_loo_auc", "meta_val_auc", "cal_val_auc", "cal_loo_auc"))
    assert len(found["meta_lr_coef"]) == 2 and found["reduced_width"] == 16
    stats = {r.model: r for r in reports.summary(test, "label", found).collect()}
    assert set(stats) == {"numeric", "text", "blend"}
    assert stats["numeric"].roc_auc == 1.0
    pages = rows.limit(3).withColumn("url", F.when(F.col("doc_id") % 2 == 0, "evil.tk").otherwise(" "))
    for r in reports.scan(pages, bundle, "doc_id", "url", "html").collect():
        assert (r.error is None) == (r.blend is not None) == (r.url is not None)
        if r.blend:
            assert 0 <= r.blend.final_score <= 1 and r.url_risk.score == 0.3 and len(r.shap.numeric_top) == 17
    report = reports.pipeline_report(pages, bundle, "doc_id", "url", "html").first()
    assert (report.stages.embedding.raw_dims, report.stages.embedding.reduced_dims) == (2 * reports.CHANNEL, 16)
    bundle.save(spark, str(tmp_path / "b"), {"features": 17})
    again, about = reports.Bundle.load(spark, str(tmp_path / "b"))
    assert about == {"features": 17}
    shown = lambda b: reports.scan(pages, b, "doc_id", "url", "html").orderBy("doc_id").collect()
    assert shown(again) == shown(bundle)
    asked = spark.createDataFrame([(1, '{"url": " evil.tk"}'), (1, '{"url": "https://evil.tk"}'), (2, "{}"), (3, None), (None, "x"), (4, '{"url": "http://nowhere"}')], "request_id long, body string")
    found = pages.select("url", F.lit("http://evil.tk/x").alias("final_url"), "html")
    for report in ("scan", "pipeline"):
        said = reports.answered(asked, found, bundle, report).collect()
        assert sorted((str(r.request_id), r.status) for r in said) == [("1", 200), ("1", 200), ("2", 400), ("3", 400), ("4", 502), ("None", 400)]
        told = {r.status: json.loads(r.answer) for r in said}
        assert told[400] == {"error": "Missing 'url' field"} and set(told[502]) == {"error"}
        assert told[200]["url"] == "http://evil.tk/x" and set(told[200]) == ({"url", "blend", "split_a", "split_b", "url_risk", "shap"} if report == "scan" else {"url", "stages"})
        assert report == "scan" or told[200]["stages"]["url_analysis"]["redirected"] is True
    # repeated and null ids stay rows of their own
    odd = pages.unionByName(pages).unionByName(pages.withColumn("doc_id", F.lit(None).cast("long")).withColumn("html", F.lit(None).cast("string")))
    assert reports.scan(odd, bundle, "doc_id", "url", "html").count() == reports.pipeline_report(odd, bundle, "doc_id", "url", "html").count() == 9


def test_training_searches_and_takes_odd_tables(spark):
    html = F.concat(F.lit("<p>"), F.sha2(F.col("doc_id").cast("string"), 256), F.repeat(F.lit("<br>"), (F.col("label") * 3).cast("int")), F.lit("</p>"))
    rows = spark.range(60).select((F.col("id") % 50).alias("doc_id"), (F.col("id") % 2).cast("int").alias("label")).withColumn("html", html)
    odd = rows.unionByName(spark.createDataFrame([(None, 1, None), (7, None, "x")], "doc_id long, label int, html string"))
    bundle, test, found = reports.train(odd, "doc_id", "html", "label", trees=3, width=4, draws=models.drawn(2))
    assert found["n_files"] == 61 and set(found["params"]) == set(found["cv_auc"]) == {"p_numeric", "p_text"}
    assert found["params"]["p_numeric"] in models.drawn(2)
    none = rows.limit(0)
    bundle, test, found = reports.train(none, "doc_id", "html", "label", draws=models.drawn(1))
    assert test.count() == found["n_files"] == len(bundle.numeric) == 0
    assert reports.summary(test, "label", found).count() == 3
    pages = rows.limit(2).withColumn("url", F.lit("http://a.b"))
    assert {r.blend.final_score for r in reports.scan(pages, bundle, "doc_id", "url", "html").collect()} == {0.5}
    assert reports.scan(pages.limit(0), bundle, "doc_id", "url", "html").count() == 0


def test_training_from_folders_describes_what_is_new(spark, tmp_path):
    root = tmp_path / "pages"
    for i in range(40):
        for folder in ("Phishing", "benign"):
            path = root / folder / str(i % 3) / f"{i}.html"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(f"<title>{folder} {i}</title><p>{'x ' * i}{'<form>' * (folder == 'Phishing')}</p>")
    run = lambda: reports.train_folder(spark, str(root), (tmp_path / "bundle").as_uri(), (tmp_path / "cache").as_uri(), trees=2, width=4, draws=[])
    _, _, first = run()
    assert (first["n_files"], first["n_described"]) == (80, 80) and first["n_signed"] > 0
    (root / "benign" / "new.htm").write_text("<p>a new page</p>")
    bundle, _, second = run()
    assert (second["n_files"], second["n_described"], second["n_signed"]) == (81, 1, 1)
    assert reports.Bundle.load(spark, (tmp_path / "bundle").as_uri())[1]["n_files"] == 81
    assert spark.read.json((tmp_path / "bundle" / "summary").as_uri()).count() == 3


def test_wide_rows_are_never_told_to_the_driver_whole(spark, monkeypatch):
    plans, stage = {}, reports.stage
    monkeypatch.setattr(reports, "stage", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and stage(df, name))
    # texts without elements have vectors of zeros, whose written rows are a few bytes each
    rows = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"), F.sha2(F.col("id").cast("string"), 256).alias("html"))
    bundle, _, _ = reports.train(rows, "doc_id", "html", "label", trees=2, width=16, draws=[])
    pages = stage(rows.withColumn("url", F.concat(F.lit("http://a.example/"), "doc_id")), "pages")
    plans["scan"] = reports.scan(pages, bundle, "doc_id", "url", "html")._jdf.queryExecution().executedPlan().toString()
    plans["report"] = reports.pipeline_report(pages, bundle, "doc_id", "url", "html")._jdf.queryExecution().executedPlan().toString()
    assert {"described", "rows", "scan", "report"} <= set(plans)
    for name in ("described", "rows", "scan", "report"):
        assert "SortMergeJoin [row_key#" in plans[name] and "BroadcastHashJoin [row_key#" not in plans[name], name
