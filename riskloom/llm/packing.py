"""Best-fit packing of token pieces into sequences, by minimum bin slack over the lengths at hand."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_batches, lean, slices, stage
from .encoder import encoder

#: Rows of one length that are numbered in one task, about.
NUMBERED = 200_000
#: Bytes of text that are encoded together.
HELD = 1 << 22


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each text's tokens and end_id, cut only if longer than capacity.

    All pieces but the first are then exactly full; piece counts from 0 and start is the number of the document's ids before it. The tokenizer adds no special tokens, and reads their strings in a text as the file says;
    null text is empty, so that it gives end_id alone. Repeated and null ids stay rows of their own; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (part for batch in batches for part in slices(batch, 1, HELD)):
            flat, bounds = encoder(path).tokens(some.column(1), end_id)
            n = np.diff(bounds)
            count = -(-n // capacity)
            owner = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            # the first piece takes what full ones leave
            over = n - (count - 1) * capacity
            start = np.where(piece, over[owner] + (piece - 1) * capacity, 0)
            length = np.where(piece, capacity, over[owner])
            places = np.append(bounds[:-1][owner] + start, bounds[-1]).tolist()
            data = flat.astype("<u4").view(np.uint8).data
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(places, places[1:], strict=False)]
            cols = [some.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(flat.view(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(lean(pieces), f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths that fills room best: subset sums as bits of one integer, longer lengths first."""
    sums, mask, steps = 1, (2 << room) - 1, []
    for size in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        for _ in range(min(counts[size], room // size)):
            more = (sums | sums << size) & mask
            if more == sums:
                break
            steps.append((size, sums))
            sums = more
            if sums >> room & 1:
                break
        if sums >> room & 1:
            break
    left, used = sums.bit_length() - 1, {}
    for size, before in reversed(steps):
        if not before >> left & 1:
            left -= size
            used[size] = used.get(size, 0) + 1
    return used


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of a bin, number of such bins) until nothing is left: the longest length left, and the fullest combination beside it."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        used = fullest(counts, capacity - seed)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((used, times))
    return out


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("id", "piece", "start", "ids_crc32")) -> DataFrame:
    """pieces with sequence_id and offset: no sequence holds over capacity, offsets are gapless from 0.

    pieces must have a column length from 1 to capacity, and be reread alike (a written table). What the driver plans with is the histogram of
    lengths, at most `capacity` numbers at any size of the data, and each bin's combination is used as often as the counts allow. Pieces of one length are numbered
    in parallel parts, so that a length that very many share isn't one task's work. Pieces equal in all of `order` are interchangeable. Nothing comes of an empty table.
    """
    tally = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= x <= capacity for x in tally):
        raise ValueError("a piece is empty or over capacity")
    parts = max(8, sum(tally.values()) // NUMBERED)
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = dict.fromkeys(tally, 0), 0
    for used, times in patterns(tally, capacity):
        offset = 0
        for size in sorted(used, reverse=True):
            by_length.setdefault(size, []).append((taken[size], used[size], sequence, offset))
            taken[size] += used[size] * times
            offset += size * used[size]
        sequence += times
    plan = {k: np.array(v, np.int64) for k, v in by_length.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, ordinal: pd.Series) -> pd.DataFrame:
        out = np.empty((len(length), 2), np.int64)
        of = length.to_numpy()
        for size in np.unique(of):
            at, steps = of == size, plan[int(size)]
            n = ordinal.to_numpy()[at]
            step = steps[np.searchsorted(steps[:, 0], n, "right") - 1]
            inside = n - step[:, 0]
            out[at] = np.stack([step[:, 2] + inside // step[:, 1], step[:, 3] + inside % step[:, 1] * size], 1)
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    bases = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    numbered = dealt.withColumn("i", F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1)
    at = placed("length", (F.col("base") + F.col("i")).cast("long"))
    return numbered.join(bases, ["length", "part"]).withColumn("at", at).select(*pieces.columns, "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token pieces of all documents, written once, with their sequence and place."""
    return pack(stage(token_pieces(docs, path, capacity, 0, id_col, text_col, with_ids), "pieces"), capacity)
