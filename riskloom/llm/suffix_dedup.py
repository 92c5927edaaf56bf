"""Removal of repeated byte strings, by bucket-pointer refinement of a sparse suffix array.

Suffixes start in q-gram buckets, each named by the place where it begins in sorted order; a bucket of several is refined by sorting on the bucket pointers of later offsets, and the new
pointers are what the next, doubled width sorts on (pointers). Only anchors enter the shuffle: every string of `length` bytes is served by the lowest q-gram inside it, so equal strings
share an anchor bucket and a place relative to the anchor, and a run of neighbouring strings shares one anchor. What has to meet from several tasks meets by identifiers (bytehash.names).

1. Anchors (bucket, refined identifier of the run's whole context) meet by bucket. Equal contexts: all but the first are repeats.
2. First contexts in a bucket that holds several are refined to single strings, batch by sorted batch.
3. Strings of a bucket that reaches over a batch's end, or of which any slice dealt out its contexts, meet by identifier.

A key that is frequent within a batch is aggregated there, and a bucket with many contexts is dealt out by context, with one
witness left behind, so that no task receives a frequent bucket whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .bytehash import _U, lowest, names, pair
from .common import keyed, lean, slices, stage

Q = 24
#: Bytes hashed at a time; longer documents are taken in overlapping pieces of PIECE bytes.
CHUNK, PIECE = 1 << 17, 1 << 22
#: Bytes of text whose anchors are held and sorted together.
HELD = 1 << 23
#: Contexts of one bucket among these from which the bucket is dealt out by context.
MANY = 16
_PLAIN, _MIXED, _WITNESS, _REPEAT = 0, 1, 2, 3
#: Of a run: its first offset, state, anchor and number of strings, in one number that sorts by offset.
_AT = {"lo": "shiftright(at, 26)", "how": "cast(shiftright(at, 24) & 3 as int)", "rel": "cast(shiftright(at, 12) & 4095 as int)", "n": "cast(at & 4095 as int)"}


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """(key, id, n_bytes, n_removed, spans, kept) per document: bytes covered by a string of `length` bytes that also starts earlier are removed.

    Earlier: in a smaller id, or in the same document further left; strings are judged on the input. spans: the maximal removed runs (start, end), in order;
    kept: the other bytes, joined. Null or empty text gives empty results; a text shorter than `length` is kept whole. Rows with equal or
    null ids are ordered by text, nulls last. whole_characters: runs grow to whole UTF-8 characters, so that kept is text. An empty table gives no rows. Columns besides id and text are not read.
    """
    if not Q <= length <= 4096:
        raise ValueError(f"length must be from {Q} to 4096")
    docs = keyed(docs, id_col, text_col)
    packed = docs.select("key", "id", "text").mapInArrow(lean(_packed), f"key long, id {dict(docs.dtypes)['id']}, z binary")
    anchors = docs.select("key", "text").mapInArrow(lean(_anchors(length)), "sb long, ctx long, key long, at long")

    bucket = Window.partitionBy("sb")
    how = F.expr(_AT["how"])
    placed = anchors.withColumn("before", F.lag("ctx").over(bucket.orderBy("ctx", "key", "at")))
    placed = placed.withColumn("mixed", (F.min("ctx").over(bucket) != F.max("ctx").over(bucket)) | F.max(how == _MIXED).over(bucket))
    # slices that hold few contexts of a bucket that others dealt out left theirs behind: these meet the dealt ones by identifier
    placed = placed.withColumn("dealt", F.max(how == _WITNESS).over(bucket))
    placed = placed.where(how != _WITNESS).withColumn("repeat", (how == _REPEAT) | F.coalesce(F.col("before") == F.col("ctx"), F.lit(False)))
    state = {"how": F.when(F.col("dealt"), F.lit(_MIXED)).otherwise(how)}
    placed = placed.where("repeat or mixed").select(F.when(~F.col("repeat"), F.col("sb")).alias("sb"), "key", *(state.get(k, F.expr(x)).alias(k) for k, x in _AT.items()))
    placed = stage(placed, "runs")
    whole = placed.where("sb is null").select("key", "lo", "n")
    firsts = placed.where("sb is not null").groupBy("key").agg(F.collect_list(F.struct("sb", "lo", "n", "rel", "how")).alias("runs"))

    contexts = packed.join(firsts, "key").select("key", "id", "z", "runs").mapInArrow(lean(_contexts(length)), "sb long, key long, lo long, rel int, how int, bytes binary")
    refined = contexts.repartition("sb").sortWithinPartitions("sb").mapInArrow(lean(_refined(length)), "h long, g long, key long, lo long, n int, repeat boolean")
    met = F.lag("key").over(Window.partitionBy("h", "g").orderBy("key", "lo")).isNotNull()
    single = refined.withColumn("repeat", F.col("repeat") | met).where("repeat").select("key", "lo", "n")

    runs = whole.unionByName(single).groupBy("key").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    kind = f"key long, id {dict(docs.dtypes)['id']}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    return packed.join(runs, "key", "left").select("key", "id", "z", "runs").mapInArrow(lean(_cut(length, whole_characters)), kind)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = pa.array([pack.compress(x.as_buffer()) for x in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], ["key", "id", "z"])


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column]


def _chunks(keys: list[int], texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts side by side: (bytes, keys, starts of the texts in bytes, offset of each in its document)."""
    part, ks, starts, bases, n = [], [], [], [], 0
    for k, t in zip(keys, texts, strict=True):
        for base in range(0, max(len(t) - length, 0) + 1, PIECE):
            piece = t[base : base + PIECE + length - 1] if len(t) > PIECE else t
            if len(piece) < length:
                continue
            part.append(piece), ks.append(k), starts.append(n), bases.append(base)
            n += len(piece)
            if n >= CHUNK:
                yield np.frombuffer(b"".join(part), np.uint8), np.array(ks), np.array(starts), np.array(bases)
                part, ks, starts, bases, n = [], [], [], [], 0
    if part:
        yield np.frombuffer(b"".join(part), np.uint8), np.array(ks), np.array(starts), np.array(bases)


def _runs(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings that share an anchor: (first string, last string, anchor, bucket, context identifier)."""
    gram, full = names(data, Q, length)
    order = (gram >> _U(24) << _U(24)) | np.arange(len(gram), dtype=_U)
    at = (lowest(order, length - Q + 1) & _U((1 << 24) - 1)).astype(np.int64)
    inside = np.ones(len(at), bool)
    for end in starts[1:]:
        inside[max(0, end - length + 1) : end] = False
    s = np.flatnonzero(inside)
    a = at[s]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
    lo, hi, x = s[new], np.append(s[new[1:] - 1], s[-1]), a[new]
    return lo, hi, x, gram[x], pair(pair(full[lo], full[hi]), (x - lo).astype(_U))


def _anchors(length: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, HELD)):
            got = []
            for data, keys, starts, bases in _chunks(batch.column(0).to_pylist(), _texts(batch.column(1)), length):
                lo, hi, x, b, c = _runs(data, starts, length)
                i = np.searchsorted(starts, lo, "right") - 1
                got.append((b.view(np.int64), c.view(np.int64), keys[i], lo - starts[i] + bases[i], hi - lo + 1, x - lo))
            if not got:
                continue
            b, c, key, lo, n, rel = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((lo, key, c, b))
            b, c, key, lo, n, rel = (x[order] for x in (b, c, key, lo, n, rel))
            new_b = np.concatenate([[True], b[1:] != b[:-1]])
            first = new_b | np.concatenate([[True], c[1:] != c[:-1]])
            group = np.cumsum(new_b) - 1
            many = (np.bincount(group, first) >= MANY)[group]
            how = np.where(~first, _REPEAT, np.where(many, _MIXED, _PLAIN))
            sb = b.copy()
            dealt = ~first | many
            sb[dealt] = pair(pair(b[dealt].view(_U), c[dealt].view(_U)), np.where(first, 0, key + lo)[dealt].astype(_U)).view(np.int64)
            seen = np.flatnonzero(many & new_b)
            at = lo << 26 | how << 24 | rel << 12 | n
            # a witness differs in its context from any other row of the bucket
            rows = (sb, b[seen]), (c, c[seen] ^ 1), (key, key[seen]), (at, np.full(len(seen), _WITNESS << 24))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in rows], ["sb", "ctx", "key", "at"])

    return anchors


def _contexts(length: int):
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_ = ["sb", "key", "lo", "rel", "how", "bytes"]
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            runs = batch.column(3)
            flat, ends = runs.flatten(), np.cumsum(runs.value_lengths().to_numpy())
            sb, lo, n, rel, how = (flat.field(i) for i in range(5))
            owner = np.searchsorted(ends, np.arange(len(flat)), "right")
            out, lows, sizes, text = [], lo.to_numpy(), n.to_numpy(), b""
            was = -1
            for i, (o, a, m) in enumerate(zip(owner.tolist(), lows.tolist(), sizes.tolist(), strict=True)):
                if o != was:
                    text, was = unpack.decompress(batch.column(2)[o].as_buffer()), o
                out.append(text[a : a + m - 1 + length])
                if len(out) == 20000 or i == len(flat) - 1:
                    at = slice(i + 1 - len(out), i + 1)
                    yield pa.RecordBatch.from_arrays([sb[at], batch.column(0).take(pa.array(owner[at])), lo[at], rel[at], how[at], pa.array(out, pa.binary())], names_)
                    out = []

    return contexts


def pointers(gram: np.ndarray, room: np.ndarray, q: int, length: int) -> np.ndarray:
    """Bucket pointers of the strings of `length` bytes at each offset: equal where the strings are equal, among offsets with room for them.

    gram: identifiers of the q bytes at each offset; room: bytes from an offset to its text's end. Offsets that have no room for a width keep what they had, which nothing reads.
    """
    order = np.argsort(gram, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]])) if len(gram) else order
    now, wide = np.empty(len(gram), np.int64), q
    now[order] = np.repeat(starts, np.diff(np.append(starts, len(gram))))
    while wide < length:
        step = min(wide, length - wide)
        members = np.bincount(now[room >= wide + step], minlength=len(gram))
        live = np.flatnonzero((room >= wide + step) & (members[now] > 1))
        wide += step
        if not len(live):
            continue
        later = now[live + step]
        order = np.lexsort((later, now[live]))
        old, later = now[live][order], later[order]
        first = np.concatenate([[True], old[1:] != old[:-1]])
        begin = np.flatnonzero(first)
        rank = np.arange(len(old)) - np.repeat(begin, np.diff(np.append(begin, len(old))))
        fresh = np.flatnonzero(first | np.concatenate([[False], later[1:] != later[:-1]]))
        now = now.copy()
        now[live[order]] = np.repeat((old + rank)[fresh], np.diff(np.append(fresh, len(old))))
    return now


def _refined(length: int):
    def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sb, key, lo, rel, how = (batch.column(i).to_numpy() for i in range(5))
            open_ = (sb == sb[0]) | (sb == sb[-1]) | (how == _MIXED)
            buffers = batch.column(5).buffers()
            ends = np.frombuffer(buffers[1], np.int32)[batch.column(5).offset :][: batch.num_rows + 1].astype(np.int64)
            data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            sizes = ends[1:] - ends[:-1] - length + 1
            row = np.repeat(np.arange(len(sizes)), sizes)
            off = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            gram, full = names(data, Q, length)
            room = (np.repeat(ends[1:], ends[1:] - ends[:-1]) - np.arange(len(data)))[: len(gram)]
            place = ends[:-1][row] + off
            g = full[place]
            h = pair(pair(gram[ends[:-1] + rel], _U(7))[row], g + (rel[row] - off).astype(_U))
            at = key[row], lo[row] + off
            same = pointers(gram, room, Q, length)[place]
            order = np.lexsort((at[1], at[0], same))
            h, g, same, row, k, p = h[order], g[order], same[order], row[order], at[0][order], at[1][order]
            repeat = np.concatenate([[False], same[1:] == same[:-1]])
            # repeats found here need no meeting: neighbours go as one run, under a key of their own
            r, q = row[repeat], p[repeat]
            order = np.lexsort((q, r))
            r, q = r[order], q[order]
            new = np.flatnonzero(np.concatenate([[True] * bool(len(r)), (r[1:] != r[:-1]) | (q[1:] != q[:-1] + 1)]))
            n = np.diff(np.append(new, len(r)))
            r, q = r[new], q[new]
            meet = ~repeat & open_[row]
            cols = [
                np.concatenate([pair(key[r].astype(_U), q.astype(_U)), h[meet]]).view(np.int64),
                np.concatenate([q, g[meet].view(np.int64)]),
                np.concatenate([key[r], k[meet]]),
                np.concatenate([q, p[meet]]),
                np.concatenate([n, np.ones(meet.sum(), np.int64)]).astype(np.int32),
                np.arange(len(r) + meet.sum()) < len(r),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "g", "key", "lo", "n", "repeat"])

    return refined


def _grown(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that take in the rest of characters they cut."""
    inside = lambda at: at < len(text) and text[at] & 0xC0 == 0x80
    one, two = [], []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        while inside(a):
            a -= 1
        while inside(b):
            b += 1
        if two and a <= two[-1]:
            two[-1] = b
        else:
            one.append(a), two.append(b)
    return np.array(one), np.array(two)


def _cut(length: int, whole_characters: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, removed, spans, kept, held = [], [], [], [], 0
            done = 0
            for i in range(batch.num_rows):
                text, runs = unpack.decompress(batch.column(2)[i].as_buffer()), batch.column(3)[i]
                gone: list[dict] = []
                rest = text
                if runs.is_valid:
                    lo, n = (runs.values.field(j).to_numpy() for j in range(2))
                    order = np.argsort(lo, kind="stable")
                    start, end = lo[order], np.maximum.accumulate((lo + n - 1 + length)[order])
                    new = np.concatenate([[True], start[1:] > end[:-1]])
                    start, end = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                    if whole_characters:
                        start, end = _grown(text, start, end)
                    gone = [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                    rest = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True))
                sizes.append(len(text)), removed.append(len(text) - len(rest)), spans.append(gone), kept.append(rest)
                held += len(rest)
                if held > 1 << 24 or i == batch.num_rows - 1:
                    at = slice(done, i + 1)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[at], batch.column(1)[at], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["key", "id", "n_bytes", "n_removed", "spans", "kept"])
                    sizes, removed, spans, kept, held, done = [], [], [], [], 0, i + 1

    return cut
