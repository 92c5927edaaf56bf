"""The corpus pipeline: four stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import ngram_join, packing, quality, suffix_dedup
from riskloom.llm.common import stage, unused


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: a chance of a half or more of being good. Null text counts as empty; repeated rows are judged alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.rated(docs, labels), quality.GRADES)
    return quality.keep(docs, model, keep_from=2)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a unique, non-null key that rises with (doc_id, text), nulls last, and its name: the id itself where that will do, else written once, so that it can't change."""
    key = unused(docs, "key")
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint") and docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.coalesce("text", F.lit("")))
    return stage(ordered.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id. Documents without shingles (null or empty text) are groups of their own and stay, repeated rows of them too; of rows equal in another text one stays."""
    rows, key = _numbered(docs)
    groups = ngram_join.jaccard_groups(rows.select(key, "text"), 75, 5, id_col=key)
    first = groups.where("id = component_id").select(F.col("id").alias(key))
    return rows.join(first, key, "left_semi").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that stand earlier in the corpus; a character that is cut goes whole. Texts of which nothing is left go; texts without repeats, null and empty ones too, stay as they are."""
    rows, key = _numbered(docs)
    cut = suffix_dedup.remove_repeats(rows.select(key, "text"), 100, id_col=key, whole_characters=True)
    rest = unused(rows, "rest")
    joined = rows.join(cut.select(F.col("id").alias(key), F.struct(F.decode("kept", "UTF-8").alias("text"), "n_removed").alias(rest)), key)
    n_removed, left = F.col(rest)["n_removed"], F.col(rest)["text"]
    kept = F.when(n_removed > 0, left).otherwise(F.col("text"))
    out = {"text": kept, "n_chars": F.when(F.col("text").isNotNull(), F.length(kept)).cast("long")}
    return joined.where((n_removed == 0) | (left != "")).select(*(out.get(c, F.col(c)).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the texts with their ids, packed into sequences of 2048. Null and empty texts give the end's id alone; repeated and null ids stay rows of their own."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, 2048).withColumnRenamed("id", "doc_id")


STAGES = [("quality", good_documents), ("near_copies", one_of_each_group), ("repeats", without_repeats), ("packing", packed)]
#: SQL says neither the classifier nor the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written and read again. Repeated rows, null ids and null texts are what the stages say; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
