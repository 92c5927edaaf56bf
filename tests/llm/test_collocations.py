"""Collocations against a plain count, and the query against its SQL."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from riskloom.llm import collocations, queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, top=2000):
    out, by_lang = [], {}
    for lang, text in rows:
        by_lang.setdefault(lang or "und", []).append((text or "").translate(LOWER))
    for lang, texts in by_lang.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                for k in range(1, longest + 1):
                    f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        hidden = set()
        for p, b in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if b >= found[p[i : i + k]]:
                        hidden.add(p[i : i + k])
        scored = []
        for p, a in found.items():
            if p not in hidden:
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, phrase.decode(), -a, left, right, n, -score) for i, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "état", "ÉTAT", "x y", "a-b", "rare"] + [f"w{i}" for i in range(30)]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", " \t ", "\x0b"]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None])
        parts = []
        for _ in range(rng.randrange(0, 60)):
            parts.append("of the old state of" if rng.random() < 0.2 else words[min(int(rng.expovariate(0.2)), len(words) - 1)])
            parts.append(rng.choice(ends))
        rows.append((lang, "".join(parts)))
    return rows + [("en", None), ("fr", ""), (None, "..."), ("long", "la " * 60_000), ("one", "word")]


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(3)


@pytest.mark.parametrize(("seed", "least", "longest", "top", "small"), [(0, 3, 5, 2000, {}), (1, 300, 5, 2000, {}), (2, 2, 3, 7, {"HELD": 300, "WINDOWS": 40}), (3, 4, 5, 2000, {"HELD": 300, "FEWEST": 64, "MOST": 64, "CHUNK": 16})])
def test_phrases_are_the_plain_ones(spark, monkeypatch, seed, least, longest, top, small):
    for name, value in small.items():
        monkeypatch.setattr(collocations, name, value)
    rows = made(seed)
    got = collocations.mine(table(spark, rows), least, longest, top)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(rows, least, longest, top)


def test_words_and_their_neighbours():
    words = collocations._Words(pa.record_batch({"lang": ["en", "und"], "text": ["A b. c  d\tE", None]}))
    assert words.names.to_pylist() == ["a", "b", "c", "d", "e"]
    assert words.next.tolist() == [True, False, True, True, False]


def test_no_rows(spark):
    assert collocations.mine(table(spark, [])).count() == 0
    assert collocations.mine(table(spark, [("en", "a b c")])).count() == 0


def test_the_query_is_the_plain_one_and_its_sql(spark):
    sf001 = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("lang", "text").collect()]
    got = sorted(map(tuple, queries.op11_collocations(spark, sf001).select(COLUMNS).collect()))
    assert got == plain(rows, 100)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf001}/documents.parquet'")
    assert sorted(map(tuple, duckdb.sql(queries.ORACLES["op11_collocations"]).select(", ".join(COLUMNS)).fetchall())) == got
