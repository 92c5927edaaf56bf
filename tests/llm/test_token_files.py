"""Token files: the code of boundaries, the files, and the query against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from riskloom.llm import queries, token_files
from riskloom.llm.token_files import EliasFano

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 62), 1 << 62) | st.integers(0, 5), max_size=700), st.data())
def test_numbers_come_back(values, data):
    values = np.sort(np.array(values, np.int64))
    head, raw = EliasFano.of(values).to_bytes()
    own = EliasFano.from_bytes(head, raw)
    assert own.between(0, len(values)).tolist() == values.tolist()
    if len(values):
        a = data.draw(st.integers(0, len(values) - 1))
        b = data.draw(st.integers(a, len(values)))
        assert own.between(a, b).tolist() == values[a:b].tolist()
        assert own.select(a) == values[a]


def test_the_code_is_near_minimal_and_refuses_what_falls():
    rng = np.random.default_rng(1)
    bounds = np.cumsum(rng.integers(1, 3000, 100_000))
    _, raw = EliasFano.of(bounds).to_bytes()
    least = np.log2(bounds[-1] / len(bounds)) + 2
    assert 8 * len(raw) / len(bounds) < least + 0.2
    with pytest.raises(ValueError, match="must not fall"):
        EliasFano.of(np.array([3, 2]))
    with pytest.raises(IndexError):
        EliasFano.of(np.array([1])).select(1)


def plain(rows):
    model, at, out = Tokenizer.from_file(PATH), 0, []
    for i, text in rows:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_the_query_is_the_plain_one(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op13_token_files(spark, sf001).collect())
    assert got == plain(sorted((r.doc_id, r.text) for r in docs))


def test_files_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_BYTES", 64)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b.", "Ünï", "\n", "  ", "汉字"]) for _ in range(rng.randrange(30)))) for i in rng.sample(range(-500, 500), 60)]
    rows += [(600, None), (601, ""), (602, "<|endoftext|> x"), (603, "word " * 20_000), (None, None)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, start int").repartition(5)
    folder = (tmp_path / "f").as_uri()
    token_files.write(table, folder, PATH)
    want = plain(sorted(rows, key=lambda r: (r[0] is None, r[0])))
    got = sorted(((r.id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_files.read(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    assert [zlib.crc32(token_files.document(folder, i).astype("<u4").tobytes()) for i in (0, 7, 63)] == [want[i][3] for i in (0, 7, 63)]
    with pytest.raises(IndexError):
        token_files.document(folder, len(rows))
    with pytest.raises(Exception, match="written already"):
        token_files.write(table, folder, PATH)


def test_repeated_and_null_ids_stay(spark, tmp_path):
    rows = [(1, "a"), (1, "b c"), (1, "a"), (None, "d"), (None, "d")]
    folder = (tmp_path / "f").as_uri()
    token_files.write(spark.createDataFrame(rows, "doc_id int, text string"), folder, PATH)
    got = token_files.read(spark, folder).orderBy("start").collect()
    assert [r.id for r in got] == [1, 1, 1, None, None]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(5)]


def test_no_rows_and_ids_that_are_no_numbers(spark, tmp_path):
    folder = (tmp_path / "f").as_uri()
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)
    assert token_files.read(spark, folder).count() == 0
    with pytest.raises(ValueError, match="whole number"):
        token_files.write(spark.createDataFrame([("a", "b")], "doc_id string, text string"), folder, PATH)


def test_unsorted_rows_are_refused(spark, tmp_path):
    spark.dataSource.register(token_files.TokenIds)
    rows = spark.createDataFrame([(2, b"\0\0\0\0"), (1, b"\0\0\0\0")], "id long, ids binary").coalesce(1)
    with pytest.raises(Exception, match="sorted by id"):
        rows.write.format("token_ids").mode("append").save((tmp_path / "g").as_uri())
