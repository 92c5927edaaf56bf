"""Labelled page corpora on disk, model and summary files, saved pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Characters of a fetched page that are kept.
FETCHED = 500_000


def labelled_pages(spark: SparkSession, root: str) -> DataFrame:
    """(path, label, html) of .html and .htm files below the folders in root: label 1 for folders whose name begins with "phish" in any case.

    Files directly in root are left out. Bytes that aren't UTF-8 are read as Latin-1; line ends become \\n. A missing root fails.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{html,htm}").load(root)
    inside = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), F.lit("^" + _escaped(root.rstrip("/")) + "/"), F.lit(""))
    folder = F.regexp_extract(inside, "^([^/]+)/", 1)
    text = F.col("content").cast("string")
    read = F.when(F.is_valid_utf8(text), text).otherwise(F.decode("content", "ISO-8859-1"))
    return files.where(folder != "").select("path", F.lower(folder).startswith("phish").cast("int").alias("label"), F.regexp_replace(read, "\r\n?", "\n").alias("html"))


def _escaped(path: str) -> str:
    path = "/" + path.split(":", 1)[-1].lstrip("/") if ":" in path else path
    return "".join("\\" + c if c in r"\.^$*+?()[]{}|" else c for c in path)


def fetched(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Pages cut to the length that a fetch keeps. Fetching itself is outside: pages come as a table of (url, html)."""
    return pages.withColumn(html_col, F.substring(html_col, 1, FETCHED))


def save_by_host(pages: DataFrame, path: str, url_col: str = "url", html_col: str = "html") -> None:
    """Write pages in folders by host, whose name keeps letters, digits, dots and hyphens."""
    host = F.regexp_replace(F.regexp_extract(url_col, r"://([^/?#]*)", 1), r"[^\w.\-]", "_")
    pages.select(host.alias("host"), F.col(html_col).alias("value")).write.partitionBy("host").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def missing_rows(wanted: DataFrame, cache: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of wanted that a cache of this version lacks, by content key."""
    return wanted.join(cache.where(F.col("version") == version).select(key), key, "left_anti")
