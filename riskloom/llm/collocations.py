"""Phrase collocations: only the longest windows are counted, and ROLLUP sums their shorter beginnings."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .bytehash import pair
from .common import bounded_batches, lean, slices, stage

#: Counters of phrases of one length: four for each phrase that could be frequent, within these bounds (of bits that every task gets); counters that are summed together.
SPARE, FEWEST, MOST, CHUNK = 4, 1 << 16, 1 << 28, 1 << 16
#: Bytes of text for a word, about.
WORD_BYTES = 6
#: Bytes of text that are split together, and distinct windows that a task holds.
HELD, WINDOWS = 4 << 20, 1 << 20
#: Bytes of text that a task counts windows of, if there are more than two such tasks a core: a task passes a window on once, so that larger tasks pass fewer.
TASK_BYTES = 256 << 20
#: What ends a piece, besides a text.
ENDS = r"[.,;:!?\n-\r]"


class _Words:
    """The words of some texts: distinct ones, the number of each word's in them, its language's, and whether the next word lies in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column(0).dictionary_encode()
        text = pc.replace_substring(pc.ascii_lower(pc.fill_null(batch.column(1), "")), "\t", " ")
        pieces = pc.split_pattern_regex(text, ENDS)
        split = pc.split_pattern(pieces.flatten(), " ")
        words = split.flatten()
        full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # spaces in a row leave empty ones
        piece = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))[full]
        coded = words.filter(pa.array(full)).dictionary_encode()
        self.names, self.ids = coded.dictionary, coded.indices.to_numpy()
        self.langs = langs.dictionary
        self.lang = np.repeat(langs.indices.to_numpy(), np.diff(pieces.offsets.to_numpy()))[piece]
        self.next = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, bool)

    def buckets(self, counters: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For phrases of 1, 2, .. words: the counter of the phrase that begins at each word, and whether its piece holds one."""
        name = np.array([zlib.crc32(x.encode()) for x in self.names.to_pylist()], np.uint64)
        word = name[self.ids]
        mixed, fits = np.array([zlib.crc32(x.encode()) for x in self.langs.to_pylist()], np.uint64)[self.lang], np.ones(len(word), bool)
        for k in range(longest):
            if k:
                fits = fits & _ahead(self.next, k - 1)
            mixed = pair(mixed, _ahead(word, k))
            yield (mixed % np.uint64(counters)).astype(np.uint32), fits


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    """x, k places on; zeros at the end."""
    return x if not k else np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])


def _held_in(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _frequent(rows: DataFrame, least: int, counters: int, sizes: range, known: list[np.ndarray]) -> list[np.ndarray]:
    """For each size of a phrase, a bit for each counter: whether the phrases that share it come up `least` times together. What a counter below it counts is no frequent phrase; the rest is only likely.

    known: the bits of smaller sizes; a phrase is counted only where its parts may be frequent. Tasks send the counters that they have met, in parts of CHUNK, which are summed by many tasks; bits come to the driver,
    as many as there are counters at any size of the data.
    """
    longest, size, chunk = sizes.stop - 1, HELD, min(CHUNK, counters)
    told = rows.sparkSession.sparkContext.broadcast(known)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (part for batch in batches for part in slices(batch, 1, size)):
            words, ok = _Words(some), []
            for k, (at, fits) in enumerate(words.buckets(counters, longest), 1):
                # so far as its first and its last words but one may be frequent
                fits = fits if not ok else fits & ok[-1] & _ahead(ok[-1], 1)
                ok.append(fits & _held_in(told.value[k - 1], at) if k <= len(told.value) else fits)
                if k < sizes.start:
                    continue
                met, n = np.unique(at[fits], return_counts=True)
                n, part = np.minimum(n, 255 if least < 256 else least).astype("u1" if least < 256 else "<u4"), met // chunk
                cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(met)] if len(met) else [0]
                low = (met % chunk).astype("<u2" if chunk <= 1 << 16 else "<u4")
                for i in range(0, len(cuts) - 1, 512):
                    ends = list(zip(cuts[i : i + 512], cuts[i + 1 : i + 513], strict=False))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(ends), pa.int32()), pa.array([int(part[a]) for a, _ in ends], pa.int32()), pa.array([low[a:b].tobytes() for a, b in ends], pa.binary()), pa.array([n[a:b].tobytes() for a, b in ends], pa.binary())],
                        ["k", "chunk", "at", "n"],
                    )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums, out = None, np.zeros(chunk, np.uint32), []
        for batch in batches:
            for k, part, at, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (k, part) != key:
                    if key:
                        out.append((*key, np.packbits(sums >= least).tobytes()))
                    key, sums = (k, part), np.zeros(chunk, np.uint32)
                at = np.frombuffer(at, "<u2" if chunk <= 1 << 16 else "<u4")
                sums[at] = np.minimum(sums[at] + np.frombuffer(n, "u1" if least < 256 else "<u4"), least)
        if key:
            out.append((*key, np.packbits(sums >= least).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["k", "chunk", "bits"])

    parts = rows.mapInArrow(lean(tally), "k int, chunk int, at binary, n binary").repartition("k", "chunk").sortWithinPartitions("k", "chunk").mapInArrow(lean(summed), "k int, chunk int, bits binary")
    bits = [np.zeros(counters // 8, np.uint8) for _ in sizes]
    for r in parts.toLocalIterator():
        bits[r["k"] - sizes.start][r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def windows(rows: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, w1 .. w<longest>, n): the windows that begin at each word, as far as their words may make a frequent phrase, padded with "", and how often a task has met them.

    What may be frequent is told by counters that phrases share; they are as many as the text's bytes ask for, up to MOST. Beyond that (if `least` stays as it is) windows are longer than they need to be, which changes no count.

    rows are (lang, text). Words that can't be frequent are counted together, as a window of padding alone, so that a language's counts add up to its words.
    """
    context, size = rows.sparkSession.sparkContext, rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(2 * context.defaultParallelism, size // TASK_BYTES)
    counters = 1 << (min(max(SPARE * (size // WORD_BYTES) // least, FEWEST), MOST) - 1).bit_length()
    bits = _frequent(rows, least, counters, range(1, min(longest, 2) + 1), [])
    bits += _frequent(rows, least, counters, range(3, longest + 1), bits) if longest > 2 else []
    known = context.broadcast(bits)
    columns, size, most = [f"w{i + 1}" for i in range(longest)], HELD, WINDOWS

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, langs = pa.array([""]), pa.array([], pa.string())
        held: list[pa.Table] = []

        def ids(values: pa.Array, of: pa.Array) -> tuple[np.ndarray, pa.Array]:
            found = pc.index_in(values, value_set=of)
            if found.null_count:
                of = pa.concat_arrays([of, values.filter(pc.is_null(found))])
                found = pc.index_in(values, value_set=of)
            return found.to_numpy(), of

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", *columns], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", *columns, "n"])

        def out() -> Iterator[pa.RecordBatch]:
            for some in held[0].to_batches(max_chunksize=1 << 16):
                strings = [langs.take(some.column(0)), *(names.take(some.column(i + 1)) for i in range(longest))]
                yield pa.RecordBatch.from_arrays([*strings, some.column(longest + 1)], ["lang", *columns, "n"])

        for some in (part for batch in batches for part in slices(batch, 1, size)):
            words = _Words(some)
            if not len(words.ids):
                continue
            ok: list[np.ndarray] = []
            for bits, (at, fits) in zip(known.value, words.buckets(counters, longest), strict=True):
                ok.append((fits & ok[-1] & _ahead(ok[-1], 1) if ok else fits) & _held_in(bits, at))
            kept = ok[0]
            used = np.zeros(len(words.names), bool)
            used[words.ids[kept]] = True
            number = np.zeros(len(words.names), np.int32)
            number[used], names = ids(words.names.filter(pa.array(used)), names)
            lang, langs = ids(words.langs, langs)
            at = number[words.ids]
            cols = [np.where(on, _ahead(at, k), 0).astype(np.int32) for k, on in enumerate(ok)]
            table = pa.table({"lang": lang[words.lang].astype(np.int32), **dict(zip(columns, cols, strict=True))})
            held.append(table.group_by(["lang", *columns], use_threads=False).aggregate([([], "count_all")]).rename_columns(["lang", *columns, "n"]))
            if sum(len(x) for x in held) > most:
                held[:] = [added()]
                if len(held[0]) > most // 2:
                    yield from out()
                    names, langs, held[:] = names[:1], langs[:0], []
        if held:
            held[:] = [added()]
            yield from out()

    return rows.coalesce(tasks).mapInArrow(lean(windowed), ", ".join(["lang string", *(f"{c} string" for c in columns), "n long"]))


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, size, phrase, f), written: all phrases of up to `longest` words that come up `least` times in a language, and with size 0 its words' number.

    A-Z are lower-cased; texts are cut at . , ; : ! ? and line ends into pieces, and these at spaces and tabs into words. Overlaps count. Null text is empty, null lang is "und". Distinct windows are summed before ROLLUP makes
    a row of each of their beginnings.
    """
    rows = bounded_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    columns = [f"w{i + 1}" for i in range(longest)]
    whole = windows(rows, least, longest).groupBy("lang", *columns).agg(F.sum("n").alias("n"))
    # of ROLLUP's columns those that are summed over are null; padding is not
    summed = whole.rollup("lang", *columns).agg(F.sum("n").alias("f"))
    size = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    last = F.coalesce(*(F.col(c) for c in reversed(columns)))
    found = summed.withColumn("size", size).where(F.col("lang").isNotNull() & ((F.col("size") == 0) | (last != "") & (F.col("f") >= least)))
    return stage(found.select("lang", "size", F.concat_ws(" ", *columns).alias("phrase"), "f"), "phrases")


def mine(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words with a = f(phrase) >= least.

    A cut after the first k words gives l = f(first part), r = f(rest) and the score floor(1000 a n / (l r)); the cut that scores least counts, the first of those equal. Phrases that lie in a longer one as frequent are left out:
    it is enough to look one word further, as what lies between is as frequent as both. Ranks go by score and a, falling, then by the phrase's bytes. Arithmetic is on decimals of 38 digits. An empty table, or one without frequent
    phrases, gives no rows; other columns are not read.
    """
    found = phrases(docs, least, longest, lang_col, text_col)
    totals = found.where("size = 0").select("lang", F.col("f").alias("n"))
    longer = found.where("size > 2")
    inner = longer.select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"), F.lit(None).cast("long").alias("a"), F.col("f").alias("around"))
    own = found.where("size >= 2").select("lang", "phrase", F.col("f").alias("a"), F.lit(0).cast("long").alias("around"))
    kept = own.unionByName(inner).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("around").alias("around")).where("around < a").drop("around")
    words = F.size(F.split("phrase", " "))
    cuts = kept.join(totals, "lang").withColumn("k", F.explode(F.sequence(F.lit(1), words - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    parts = found.where(F.col("size").between(1, longest - 1))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(a as decimal(19, 0)) * cast(n as decimal(16, 0)) * cast(1000 as decimal(4, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
