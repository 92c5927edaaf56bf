"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A space is written as the marker U+2581, one marker stands before the text, and characters without a piece fall back to bytes. The pieces and scores come from a
model file; where its pieces were learnt by merging, its scores still rank them, and the path of the largest sum is taken.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

from .common import bounded_batches, slices

MARK = "▁"
#: Segments up to so many bytes go through the trie side by side; longer ones alone.
SIDE_BY_SIDE = 64
#: Segments that are remembered, none longer than SIDE_BY_SIDE bytes; bytes of text that are Python strings together.
_CACHED, HELD = 1 << 18, 1 << 20


@dataclass
class Pieces:
    """A vocabulary as a double array: from node n, byte b leads to base[n] + b if check there is n; value is the piece that ends at a node, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    surface: list[bytes]
    byte_ids: np.ndarray
    unknown: float
    split: str
    cache: dict[str, tuple[bytes, float]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}


def load(path: str) -> Pieces:
    """The pieces of a model file that has all 256 byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    score = np.array([model.get_score(i) for i in range(size)])
    surface, byte_ids, words = [], np.full(256, -1, np.int64), {}
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            surface.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            surface.append(b"")
        else:
            surface.append(piece.replace(MARK, " ").encode())
            words[piece.encode()] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    if any(MARK in w.decode().lstrip(MARK) for w in words):
        raise ValueError("pieces that reach over a space can't be taken segment by segment")
    # No piece crosses from other characters to a space, nor over a line's end if none holds one: texts fall into segments there.
    line = "" if any(b"\n" in w for w in words) else "\n"
    split = f" +[^ {line}]*|[^ {line}]+" + (f"|{line}" if line else "")
    return Pieces(*double_array(words), score, surface, byte_ids, float(score[list(words.values())].min()) - 10, split)


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tree: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for word, i in words.items():
        at = 0
        for b in word:
            if b not in tree[at]:
                tree[at][b] = len(tree)
                tree.append({})
            at = tree[at][b]
        ends[at] = i
    size = 8 * len(tree) + 4096
    base, check, value = (np.full(size, x, np.int64) for x in (size - 256, -1, -1))  # the last 256 places stay empty
    used = np.zeros(size, bool)
    used[0] = True
    single, several = 256, 256  # where to look for room: one child fits any hole, more children find none in the full part
    todo = [(0, 0)]
    for node, slot in todo:
        steps = sorted(tree[node])
        if not steps:
            continue
        if len(steps) == 1:
            while used[single]:
                single += 1
            at = single - steps[0]
        else:
            offsets, start = np.array(steps), several - steps[0]
            while True:
                fits = np.flatnonzero(~used[np.arange(start, start + 64)[:, None] + offsets].any(1))
                if len(fits):
                    break
                start += 64
            at = start + int(fits[0])
            if at + steps[0] - several > 256:
                several = at + steps[0] - 64
        base[slot] = at
        for b in steps:
            used[at + b], check[at + b] = True, slot
            child = tree[node][b]
            value[at + b] = ends.get(child, -1)
            todo.append((child, at + b))
    if used[size - 256 :].any():
        raise ValueError("the double array is full")
    return base, check, value


def best_path(v: Pieces, text: bytes) -> tuple[list[int], float]:
    """Pieces of the path of the largest score through one segment, markers for spaces; of equal paths, the one whose last piece starts first."""
    n, none = len(text), -float("inf")
    best, back = [0.0] + [none] * n, [(0, -1)] * (n + 1)
    for s in range(n):
        if best[s] == none:
            continue
        wide = _width(text[s])
        node, alone = 0, False
        for e in range(s, n):
            step = int(v.base[node]) + text[e]
            if v.check[step] != node:
                break
            node = step
            i = int(v.value[node])
            if i >= 0:
                alone |= e + 1 == s + wide
                if best[s] + v.score[i] > best[e + 1]:
                    best[e + 1], back[e + 1] = best[s] + float(v.score[i]), (s, i)
        if not alone and best[s] + v.unknown > best[s + wide]:
            best[s + wide], back[s + wide] = best[s] + v.unknown, (s, -1)
    ids: list[int] = []
    while n:
        s, i = back[n]
        ids += [i] if i >= 0 else v.byte_ids[list(text[s:n])][::-1].tolist()
        n = s
    return ids[::-1], best[-1]


def _width(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


_WIDTH = np.array([_width(b) for b in range(256)])


def best_paths(v: Pieces, texts: list[bytes]) -> list[tuple[list[int], float]]:
    """best_path of many short segments, all of them moving through the trie side by side."""
    out: list = [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for at in range(0, len(order), 8192):
        some = order[at : at + 8192]
        if len(texts[some[-1]]) > SIDE_BY_SIDE:
            short = [i for i in some if len(texts[i]) <= SIDE_BY_SIDE]
            for i in some[len(short) :]:
                out[i] = best_path(v, texts[i])
            some = short
        if not some:
            continue
        size = np.array([len(texts[i]) for i in some])
        wide = int(size.max())
        m = np.frombuffer(b"".join(texts[i].ljust(wide, b"\0") for i in some), np.uint8).reshape(len(some), wide).astype(np.int64)
        best = np.full((wide + 1, len(some)), -np.inf)
        best[0] = 0
        begin, piece = np.zeros((wide + 1, len(some)), np.int64), np.full((wide + 1, len(some)), -1, np.int64)
        for s in range(wide):
            row = np.flatnonzero((best[s] > -np.inf) & (size > s))
            if not len(row):
                continue
            starts, node, alone, end = row, np.zeros(len(row), np.int64), np.zeros(len(some), bool), s + _WIDTH[m[:, s]]
            for e in range(s, wide):
                step = v.base[node] + m[row, e]
                go = (v.check[step] == node) & (size[row] > e)
                row, node = row[go], step[go]
                if not len(row):
                    break
                ended = v.value[node] >= 0
                r, i = row[ended], v.value[node[ended]]
                alone[r[end[r] == e + 1]] = True
                new = best[s, r] + v.score[i]
                up = new > best[e + 1, r]
                best[e + 1, r[up]], begin[e + 1, r[up]], piece[e + 1, r[up]] = new[up], s, i[up]
            r = starts[~alone[starts]]
            new = best[s, r] + v.unknown
            up = new > best[end[r], r]
            r, new = r[up], new[up]
            best[end[r], r], begin[end[r], r], piece[end[r], r] = new, s, -1
        begin, piece = begin.T.tolist(), piece.T.tolist()
        for k, i in enumerate(some):
            n, ids = int(size[k]), []
            while n:
                s, p = begin[k][n], piece[k][n]
                ids += [p] if p >= 0 else v.byte_ids[list(texts[i][s:n])][::-1].tolist()
                n = s
            out[i] = ids[::-1], float(best[size[k], k])
    return out


def encode_texts(v: Pieces, texts: list[str]) -> list[tuple[bytes, float]]:
    """Of each text, the ids as little-endian 32-bit numbers and the path's score."""
    split = re.compile(v.split)
    parts = [split.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
    cache = v.cache
    if len(cache) > _CACHED:
        cache.clear()
    new, long = list({x for p in parts for x in p if x not in cache}), {}
    for x, (ids, total) in zip(new, best_paths(v, [x.replace(" ", MARK).encode() for x in new]), strict=True):
        (cache if len(x) <= SIDE_BY_SIDE else long)[x] = np.array(ids, "<u4").tobytes(), total
    out = []
    for p in parts:
        got = [cache[x] if x in cache else long[x] for x in p]
        out.append((b"".join([x[0] for x in got]), float(sum([x[1] for x in got]))))
    return out


def decode_ids(v: Pieces, ids: list[int]) -> str:
    """The text of ids: surfaces joined, bytes that make no character replaced by U+FFFD, and one space of the front marker dropped."""
    text = b"".join(map(v.surface.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


_WORKER: dict[int, Pieces] = {}
_COUNTS = (("n_tokens", LongType()), ("n_byte_tokens", LongType()), ("ids_crc32", LongType()), ("path_score", DoubleType()))


def _shared(given) -> Pieces:
    return _WORKER.setdefault(given.value.base.size ^ id(given.value), given.value)


def _counted(v: Pieces, got: list[tuple[bytes, float]]) -> list[pa.Array]:
    ids = [np.frombuffer(x, "<u4") for x, _ in got]
    low, high = int(v.byte_ids.min()), int(v.byte_ids.max())
    return [
        pa.array(map(len, ids), pa.int64()),
        pa.array([int(((x >= low) & (x <= high)).sum()) for x in ids], pa.int64()),
        pa.array([zlib.crc32(x) for x, _ in got], pa.int64()),
        pa.array([x for _, x in got], pa.float64()),
    ]


def encode(docs: DataFrame, vocabulary: Pieces, text_col: str = "text") -> DataFrame:
    """docs with ids array<int>, n_tokens, n_byte_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and path_score.

    The whole text is encoded; null text is empty and has no ids. A marker in a text counts as a space. Columns of these names are replaced.
    """
    names = ["ids", *(n for n, _ in _COUNTS)]
    docs = bounded_batches(docs).drop(*names)
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _shared(given)
        for batch in batches:
            for some in slices(batch, batch.schema.get_field_index(text_col), HELD):
                got = encode_texts(v, [x or "" for x in some.column(some.schema.get_field_index(text_col)).to_pylist()])
                ids = [np.frombuffer(x, "<u4") for x, _ in got]
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*some.columns, listed, *_counted(v, got)], [*some.schema.names, *names])

    schema = StructType([*docs.schema.fields]).add("ids", ArrayType(IntegerType()))
    for name, kind in _COUNTS:
        schema = schema.add(name, kind)
    return docs.mapInArrow(encoded, schema)


def decode(rows: DataFrame, vocabulary: Pieces, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids, null for null ids."""
    rows = rows.drop(out_col)
    given = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _shared(given)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                # one text's numbers at a time are Python objects
                texts = [decode_ids(v, x.values.to_pylist()) if x.is_valid else None for x in some.column(some.schema.get_field_index(ids_col))]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], [*some.schema.names, out_col])

    return rows.mapInArrow(decoded, StructType([*rows.schema.fields]).add(out_col, StringType()))


def round_trip(docs: DataFrame, vocabulary: Pieces, text_col: str = "text") -> DataFrame:
    """docs without the text, encoded and decoded again in one pass that keeps no ids: the counts of encode(), and `same`, whether the text came back but for its markers."""
    names = [*(n for n, _ in _COUNTS), "same"]
    docs = bounded_batches(docs).drop(*names)
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in docs.columns if c != text_col]

    def gone_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _shared(given)
        for batch in batches:
            for some in slices(batch, batch.schema.get_field_index(text_col), HELD):
                texts = [x or "" for x in some.column(some.schema.get_field_index(text_col)).to_pylist()]
                got = encode_texts(v, texts)
                same = [decode_ids(v, np.frombuffer(x, "<u4").tolist()) == t.replace(MARK, " ") for (x, _), t in zip(got, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), *_counted(v, got), pa.array(same)], [*kept, *names])

    schema = StructType([docs.schema[c] for c in kept])
    for name, kind in (*_COUNTS, ("same", BooleanType())):
        schema = schema.add(name, kind)
    return docs.mapInArrow(gone_through, schema)
