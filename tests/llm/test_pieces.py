import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from riskloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(PATH)


TEXTS = ["Hello world", " a  b ", "x\ny", "naïve café 中文", "", "   ", "<s>", "The erinnd thblest, ofanlyou hainan.\nIt to only", "a" * 300, "ab cd\n\n ef", "x😀y ﷽ \x07"]


def test_same_paths_as_the_library_with_the_scores_taken_as_unigram(vocabulary, documents_sf001):
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    # in 32-bit sums a score of -1e9 hides the others, so markers in a row get one in the others' order
    for p in proto.pieces:
        if p.score < -1e8:
            p.score = -40000.0
    model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    score = vocabulary.score.copy()
    score[score < -1e8] = -40000.0
    own = pieces.Pieces(**(vocabulary.__dict__ | {"score": score, "unknown": -40010.0, "cache": {}}))
    texts = TEXTS + [t for t in documents_sf001 if t][:150]
    for text, (ids, total) in zip(texts, pieces.encode_texts(own, texts), strict=True):
        want = model.encode(text)
        got = np.frombuffer(ids, "<u4").tolist()
        if got != want:  # ties may fall otherwise; the score may not
            assert sum(score[i] for i in want) == pytest.approx(sum(score[i] for i in got))
            assert "".join(model.id_to_piece(want)) == "".join(model.id_to_piece(got))


def test_side_by_side_is_the_plain_path(vocabulary):
    words = [w.replace(" ", pieces.MARK).encode() for t in TEXTS for w in t.split(" ") if w]
    assert pieces.best_paths(vocabulary, words) == [pieces.best_path(vocabulary, w) for w in words]


def test_decoding_is_the_library_s_and_the_round_trip_whole(vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text, (ids, _) in zip(TEXTS, pieces.encode_texts(vocabulary, TEXTS), strict=True):
        got = np.frombuffer(ids, "<u4").tolist()
        assert pieces.decode_ids(vocabulary, got) == text == model.decode(got)
    assert pieces.decode_ids(vocabulary, [int(vocabulary.byte_ids[0xE4])]) == "�"


def test_trie_finds_each_piece_and_nothing_else():
    base, check, value = pieces.double_array({b"ab": 3, b"abc": 4, b"b": 5, b"\xff": 6})

    def find(word):
        node = 0
        for b in word:
            step = base[node] + b
            if check[step] != node:
                return -1
            node = step
        return value[node]

    assert [find(w) for w in (b"ab", b"abc", b"b", b"\xff", b"a", b"c", b"abcd", b"ba")] == [3, 4, 5, 6, -1, -1, -1, -1]


def test_nulls_clashing_columns_and_empty_tables(spark, vocabulary):
    rows = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (3, "", "y")], "doc_id long, text string, ids string")
    got = sorted(map(tuple, pieces.round_trip(rows, vocabulary).select("doc_id", "n_tokens", "same").collect()))
    assert got == [(1, 2, True), (1, 2, True), (2, 0, True), (3, 0, True)]
    assert pieces.round_trip(rows.limit(0), vocabulary).count() == 0


def test_both_ways_in_spark(spark, vocabulary):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "doc_id long, text string")
    coded = pieces.encode(rows, vocabulary)
    back = {r.doc_id: r for r in pieces.decode(coded, vocabulary).collect()}
    trip = {r.doc_id: r for r in pieces.round_trip(rows, vocabulary).collect()}
    for i, t in [*enumerate(TEXTS), (99, "")]:
        assert back[i].decoded == t
        assert (back[i].n_tokens, back[i].ids_crc32, back[i].path_score) == (trip[i].n_tokens, trip[i].ids_crc32, trip[i].path_score)
        assert len(back[i].ids) == back[i].n_tokens
        assert trip[i].same
