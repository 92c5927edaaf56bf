"""The batched encoder against a plain loop."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import embedding, reports


def plain(model, text):
    """One text alone, token by token."""
    ids = model.ids(text or "")
    ids = ids if len(ids) <= 512 else [*ids[:511], ids[-1]]
    states = model.states(np.array([ids]), np.ones((1, len(ids)), np.float32))[0]
    return sum(states[i].astype(float) for i in range(len(ids))) / len(ids)


def test_vectors_are_those_of_a_plain_loop(spark, documents_sf001):
    texts = [*documents_sf001[:70], "", None, "x " * 3000, "汉字" * 40]
    rows = spark.createDataFrame([(i, t, t and t[:50]) for i, t in enumerate(texts)], "id long, a string, b string").repartition(3)
    model = embedding.small_encoder()
    for r in embedding.channels(rows, "a", "b", "v").collect():
        want = np.concatenate([plain(model, r.a), plain(model, r.b)])
        assert len(r.v) == 2 * model.width and np.abs(np.array(r.v) - want).max() < 1e-4
    assert embedding.channels(rows.limit(0), "a", "b", "v").count() == 0


def test_padding_changes_nothing():
    model = embedding.small_encoder()
    one = embedding.pooled_states(model, ["a b c"])
    both = embedding.pooled_states(model, ["a b c", "a much longer text that pads the other one"])
    assert np.abs(one[0] - both[0]).max() < 1e-6


def test_a_bundle_names_its_encoder(spark, tmp_path):
    html = F.concat(F.lit("<title>"), F.when(F.col("id") % 2 == 1, "account login").otherwise("holiday pictures"), F.lit("</title><p>"), F.sha2(F.col("id").cast("string"), 256))
    rows = spark.range(60).select("id", (F.col("id") % 2).cast("int").alias("label"), html.alias("html"))
    bundle, test, _ = reports.train(rows, "id", "html", "label", trees=5, width=4, draws=[], encoder=embedding.SMALL)
    bundle.save(spark, (tmp_path / "b").as_uri())
    again, _ = reports.Bundle.load(spark, (tmp_path / "b").as_uri())
    assert again.encoder == embedding.SMALL
    pages = rows.limit(3).withColumn("url", F.lit("http://a.b"))
    report = reports.pipeline_report(pages, again, "id", "url", "html").first()
    assert report.stages.embedding.raw_dims == 2 * embedding.small_encoder().width
