"""Scoring of pages that arrive as files: the batch expressions on a stream, and saved models over each batch of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx, url as ur
from ..operators import dedup, reports


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(page_id, url, html) of Parquet files as they come."""
    return spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def rated(pages: DataFrame) -> DataFrame:
    """Score, signals, verdict and page diagnoses; works on a stream as on a table, since no row needs another."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", ur.risk(F.col("url")).alias("url_risk"), F.length(html).alias("raw_len"), tx.challenges(html).alias("challenges"), tx.parked(html).alias("parked"))
    return rows.withColumn("verdict", tx.verdict(F.col("url_risk.score")))


def scan_stream(pages: DataFrame, bundle_dir: str, out: str, checkpoint: str, fresh_for: str | None = None) -> StreamingQuery:
    """Start scanning a stream of (page_id, url, html) with the models saved in bundle_dir; reports, one a page, are added to `out` as Parquet, a folder a batch.

    A batch that runs again after a failure writes its own folder anew, so that each page is reported once. fresh_for ("1 hour"): a content and URL that came within this time before, by arrival, is not scanned again; the state that
    tells is kept for this time only. Runs through what is there and ends.
    """
    spark = pages.sparkSession
    bundle, _ = reports.Bundle.load(spark, bundle_dir)
    if fresh_for:
        seen = pages.withColumn("_at", F.current_timestamp()).withColumn("_content", dedup.content_key(F.col("html"))).withWatermark("_at", fresh_for)
        pages = seen.dropDuplicatesWithinWatermark(["url", "_content"]).drop("_at", "_content")

    def scanned(batch: DataFrame, number: int) -> None:
        reports.scan(batch, bundle, "page_id", "url", "html").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(scanned).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
