"""Scanning a stream with saved models."""

from pyspark.sql import functions as F

from riskloom.operators import reports
from riskloom.streaming import scoring


def test_a_scanned_stream_is_the_scanned_table_and_goes_on_where_it_stopped(spark, tmp_path):
    html = F.concat(F.lit("<title>t</title><p>"), F.sha2(F.col("page_id").cast("string"), 256), F.repeat(F.lit("<br>"), (F.col("label") * 4).cast("int")))
    rows = spark.range(60).select(F.col("id").alias("page_id"), (F.col("id") % 2).cast("int").alias("label")).withColumn("html", html).withColumn("url", F.concat(F.lit("http://a.b/"), "page_id"))
    bundle, _, _ = reports.train(rows, "page_id", "html", "label", trees=2, width=4, draws=[])
    where = {k: (tmp_path / k).as_uri() for k in ("bundle", "in", "out", "mark")}
    bundle.save(spark, where["bundle"])
    pages = rows.select("page_id", "url", "html")
    begin = lambda: scoring.scan_stream(scoring.page_stream(spark, where["in"], 1), where["bundle"], where["out"], where["mark"], "1 hour").awaitTermination()
    pages.where("page_id < 10").write.mode("append").parquet(where["in"])
    begin()
    # what has come before is not scanned again
    pages.where("page_id between 5 and 14").coalesce(1).write.mode("append").parquet(where["in"])
    begin()
    shown = lambda df: sorted((r.page_id, r.blend.final_score, r.url_risk.score) for r in df.collect())
    assert shown(spark.read.parquet(where["out"])) == shown(reports.scan(pages.where("page_id < 15"), bundle, "page_id", "url", "html"))
