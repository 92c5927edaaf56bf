import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from riskloom.functions import text as tx, url as ur
from riskloom.operators import dedup

# Worked out by hand from the rules.
RISKS = [
    ("https://example.com", 0.0, []),
    ("", 0.0, []),
    ("http://192.168.0.1/login", 0.55, [0.55]),
    ("http://evil.tk", 0.30, [0.30]),
    ("http://xn--pple-43d.com", 0.50, [0.40, 0.10]),
    ("http://user@example.com:8081/", 0.65, [0.45, 0.20]),
    ("secure.update.verify.a.evil.tk", 0.65, [0.35, 0.30]),
    ("http://a.b.c.example.com", 0.15, [0.15]),
    ("http://example.com/a/b/c/d/e/f", 0.10, [0.10]),
    ("http://ex%61mple.com/", 0.35, [0.35]),
    ("http://x.com:99999/", 0.0, []),
    ("http://example.com:0/", 0.0, []),
    ("http://user@xn--a-b-c-d.evil12345.tk:8081/", 1.0, [0.45, 0.40, 0.30, 0.20, 0.12]),
    ("http://[::1]:8081/x", 0.20, [0.20]),
]
TOKENS = [
    ("", "URL_EMPTY"),
    (None, "URL_EMPTY"),
    ("javascript:void(0)", "URL_JS"),
    ("JavaScript:x", "URL_INT"),
    ("HTTP://x.com", "URL_INT"),
    ("//cdn.x/y", "URL_INT"),
    ("data:text/html,x", "URL_DATA"),
    ("mailto:a@b", "URL_MAIL"),
    ("#top", "URL_ANCHOR"),
    ("https://x.com/payload", "URL_EXT_SENSITIVE"),
    ("https://x.com/about", "URL_EXT"),
]


def test_risk_goldens(spark):
    rows = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(RISKS)], "i int, u string")
    got = {r.i: (r.r.score, [s.impact for s in r.r.signals]) for r in rows.select("i", ur.risk(F.col("u")).alias("r")).collect()}
    assert got == {i: (score, impacts) for i, (_, score, impacts) in enumerate(RISKS)}


def test_risk_of_null_is_null(spark):
    assert spark.sql("select cast(null as string) as u").select(ur.risk(F.col("u")).alias("r")).first().r is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), min_size=30, max_size=60))
def test_risk_stays_between_0_and_1_and_sorted(spark, urls):
    for r in spark.createDataFrame([(u,) for u in urls], "u string").select(ur.risk(F.col("u")).alias("r")).collect():
        assert 0 <= r.r.score <= 1
        assert [s.impact for s in r.r.signals] == sorted((s.impact for s in r.r.signals), reverse=True)


def test_neutral_goldens(spark):
    rows = spark.createDataFrame(TOKENS, "h string, want string")
    assert all(r.got == r.want for r in rows.select("want", ur.neutral(F.col("h")).alias("got")).collect())


def test_normalized_redirected_and_changed(spark):
    row = spark.sql("select ' x.com ' a, 'http://x.com/' b, '  ' c").select(
        ur.normalized(F.col("a")).alias("a"), ur.normalized(F.col("b")).alias("b"), ur.normalized(F.col("c")).alias("c"),
        ur.redirected(F.lit("http://x.com"), F.lit("http://x.com//")).alias("same"), ur.domain_changed(F.lit("http://x.com/a"), F.lit("http://y.com/a")).alias("moved"),
    ).first()
    assert tuple(row) == ("https://x.com", "http://x.com/", None, False, True)


def test_verdict_goldens(spark):
    rows = spark.createDataFrame([(0.5,), (0.4999,), (0.25,), (0.2499,)], "s double")
    assert [r.v for r in rows.select(tx.verdict(F.col("s")).alias("v")).collect()] == ["phishing", "suspicious", "suspicious", "safe"]


@pytest.mark.parametrize(("said", "want"), [("Sign in to PayPal", "[ACTION] to [BRAND]"), ("please verify your account now", "please [ACTION] now"), ("authenticaté", "[ACTION]"), ("épaypal", "épaypal"), ("a  b", "a b")])
def test_scrubbing(spark, said, want):
    assert spark.createDataFrame([(said,)], "t string").select(tx.clean(tx.scrubbed(F.col("t"))).alias("t")).first().t == want


def test_shingles(spark):
    rows = spark.createDataFrame([("Ab cdE f",), ("abc",), ("",), ("aaaaaaa",), (None,)], "t string").select(dedup.summary_of_runs(tx.packed(F.col("t"))).alias("s"), tx.packed(F.col("t")).alias("t"))
    assert [(r.t, r.s.n, r.s.first) for r in rows.collect()] == [("abcdef", 2, "abcde"), ("abc", 0, None), ("", 0, None), ("aaaaaaa", 1, "aaaaa"), ("", 0, None)]
