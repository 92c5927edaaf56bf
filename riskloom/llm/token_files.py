"""Token ids in binary files: one array of ids, document boundaries and document ids beside it in Elias-Fano code.

    spark.dataSource.register(TokenIds)
    rows.write.format("token_ids").option("width", 2).mode("append").save(folder)    # id long, ids binary; sorted by id
    spark.read.format("token_ids").load(folder)                                      # id, start, n_tokens, ids

A folder holds shards and _manifest.json, which the driver writes when all tasks have ended: it lists the shards of the attempts that count, so that files of lost or repeated tasks are never read.
A shard, all numbers little-endian:

    ids         n_ids numbers of `width` bytes (2 or 4), documents one after another
    boundaries  Elias-Fano of n_docs + 1 numbers: where each document begins, and the end
    documents   Elias-Fano of the ids of the documents that have one (those without come last)
    footer      JSON: counts, and where the two sequences lie
    8 bytes     the footer's length
"""

from __future__ import annotations

import bisect
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from .common import bounded_batches, lean, shared_dir, slices
from .encoder import encoder

#: Ones of the upper bits between two samples of their places; bytes of ids that a reading task takes, and that a batch holds, about.
SAMPLED, TASK_BYTES, BATCH_BYTES = 256, 32 << 20, 4 << 20
MANIFEST = "_manifest.json"
SCHEMA = "id long, start long, n_tokens long, ids binary"


class EliasFano:
    """Non-decreasing whole numbers: of each, `bits` lower bits as they are, and the upper bits in unary, about bits + 2 bits a number.

    The i-th number's upper part is the place of the i-th one less i; the places of every SAMPLED-th one are kept, so that select() looks at the bits between two of them alone.
    """

    def __init__(self, n: int, base: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.bits, self.low, self.high, self.samples = n, base, bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        base = int(values[0]) if n else 0
        above = (values.astype(np.int64) - base).view(np.uint64)  # ids may lie over 63 bits apart
        if n and (np.diff(values) < 0).any():
            raise ValueError("numbers must not fall")
        bits = max(0, (int(above[-1]) // n).bit_length() - 1) if n else 0
        low = np.packbits((above[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (above >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, base, bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLED].astype("<u8" if n and ones[-1] >> 32 else "<u4"))

    def to_bytes(self) -> tuple[dict, bytes]:
        parts = [x.tobytes() for x in (self.low, self.high, self.samples)]
        return {"n": self.n, "base": self.base, "bits": self.bits, "sizes": [len(x) for x in parts], "sample": self.samples.dtype.itemsize}, b"".join(parts)

    @classmethod
    def from_bytes(cls, head: dict, data: bytes) -> EliasFano:
        a, b, c = head["sizes"]
        raw = np.frombuffer(data, np.uint8)
        return cls(head["n"], head["base"], head["bits"], raw[:a], raw[a : a + b], raw[a + b : a + b + c].view(f"<u{head['sample']}"))

    def between(self, start: int, end: int) -> np.ndarray:
        """Numbers start to end - 1; only their own bits and those up to the samples around them are unpacked."""
        if not 0 <= start <= end <= self.n:
            raise IndexError(f"{start} to {end} of {self.n}")
        if start == end:
            return np.zeros(0, np.int64)
        begin, last = start // SAMPLED, (end - 1) // SAMPLED + 1
        first_byte = int(self.samples[begin]) // 8
        last_byte = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first_byte:last_byte], bitorder="little")[int(self.samples[begin]) % 8 :]) + int(self.samples[begin])
        i = np.arange(start, end)
        upper = (ones[i - begin * SAMPLED] - i).astype(np.uint64) << np.uint64(self.bits)
        if self.bits:
            from_bit = start * self.bits
            taken = np.unpackbits(self.low[from_bit // 8 : -(-end * self.bits // 8)], bitorder="little")[from_bit % 8 :][: len(i) * self.bits]
            upper |= (taken.reshape(-1, self.bits).astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return upper.view(np.int64) + self.base

    def select(self, i: int) -> int:
        return int(self.between(i, i + 1)[0])


@dataclass
class Shard(WriterCommitMessage):
    """What a task has written. partition: in the order of the ranges; file is empty if there were no rows."""

    file: str = ""
    partition: int = 0
    docs: int = 0
    ids: int = 0
    nulls: int = 0
    first: int | None = None
    last: int | None = None


@dataclass
class Part(InputPartition):
    """Documents begin to end - 1 of a shard."""

    shard: Shard
    start: int
    begin: int
    end: int


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if re.match("file:/[^/]", folder) else folder if ":" in folder else os.path.abspath(folder))


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.width, self.overwrite = options["path"].rstrip("/"), int(options.get("width", 4)), overwrite
        if self.width not in (2, 4):
            raise ValueError("width is 2 or 4")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        disk, folder = _place(self.folder)
        disk.create_dir(folder, recursive=True)
        out = Shard(partition=TaskContext.get().partitionId())
        file, lengths, owners, stream = f"ids-{out.partition:06d}-{uuid.uuid4().hex}.bin", [np.zeros(1, np.int64)], [], None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                stream = stream or disk.open_output_stream(f"{folder}/{file}")
                ids = batch.column(batch.schema.get_field_index("ids"))
                data = np.frombuffer(b"".join(ids.to_pylist()), "<u4")
                if self.width == 2 and len(data) and data.max() >> 16:
                    raise ValueError("an id needs 4 bytes")
                stream.write(data.astype(f"<u{self.width}").tobytes())
                lengths.append(pa.compute.binary_length(ids).to_numpy().astype(np.int64) // 4)
                owners.append(batch.column(batch.schema.get_field_index("id")).cast(pa.int64()))
            if stream is None:
                return out
            owner = pa.chunked_array(owners).combine_chunks()
            out.nulls = owner.null_count
            known = owner.drop_null().to_numpy().astype(np.int64)
            if out.nulls and not owner.slice(len(known)).null_count == out.nulls or (np.diff(known) < 0).any():
                raise ValueError("rows must be sorted by id, those without an id last")
            bounds = np.cumsum(np.concatenate(lengths))
            (bound_head, bound_data), (doc_head, doc_data) = EliasFano.of(bounds).to_bytes(), EliasFano.of(known).to_bytes()
            footer = json.dumps({"width": self.width, "docs": len(owner), "ids": int(bounds[-1]), "nulls": out.nulls, "boundaries": bound_head, "documents": doc_head}).encode()
            stream.write(bound_data + doc_data + footer + len(footer).to_bytes(8, "little"))
        finally:
            if stream is not None:
                stream.close()
        out.file, out.docs, out.ids = file, len(owner), int(bounds[-1])
        out.first, out.last = (int(known[0]), int(known[-1])) if len(known) else (None, None)
        return out

    def commit(self, messages: list[Shard | None]) -> None:
        disk, folder = _place(self.folder)
        shards = sorted((m for m in messages if m and m.file), key=lambda m: m.partition)
        for a, b in zip(shards, shards[1:], strict=False):
            if a.nulls and b.first is not None or a.last is not None and b.first is not None and b.first < a.last:
                raise ValueError("partitions must be ranges of ids, in order")
        if not self.overwrite and disk.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{self.folder} is written already")
        disk.create_dir(folder, recursive=True)
        with disk.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"version": 1, "width": self.width, "shards": [asdict(m) for m in shards]}).encode())

    def abort(self, messages: list[Shard | None]) -> None:
        disk, folder = _place(self.folder)
        for m in messages:
            if m and m.file:
                disk.delete_file(f"{folder}/{m.file}")


class ShardFile:
    """One shard, read by places."""

    def __init__(self, disk: fs.FileSystem, path: str):
        self.file = disk.open_input_file(path)
        size = self.file.size()
        n = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.footer = json.loads(self.file.read_at(n, size - 8 - n))
        self.width = self.footer["width"]
        b, d = self.footer["boundaries"], self.footer["documents"]
        at = self.footer["ids"] * self.width
        self.boundaries = EliasFano.from_bytes(b, self.file.read_at(sum(b["sizes"]), at))
        self.documents = EliasFano.from_bytes(d, self.file.read_at(sum(d["sizes"]), at + sum(b["sizes"])))

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """Ids of the shard's i-th document: two selects and one read."""
        start, end = self.boundaries.between(i, i + 2).tolist()
        return self.ids(start, end)

    def owners(self, begin: int, end: int) -> pa.Array:
        """Ids of documents, null for those without."""
        known = min(end, self.documents.n)
        return pa.concat_arrays([pa.array(self.documents.between(min(begin, known), known)), pa.nulls(end - max(begin, known), pa.int64())])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")

    def shards(self) -> list[Shard]:
        disk, folder = _place(self.folder)
        with disk.open_input_stream(f"{folder}/{MANIFEST}") as f:
            return [Shard(**x) for x in json.loads(f.read())["shards"]]

    def partitions(self) -> list[Part]:
        out, start = [], 0
        for s in self.shards():
            parts = min(s.docs, max(1, s.ids * 4 // TASK_BYTES))
            out += [Part(s, start, s.docs * k // parts, s.docs * (k + 1) // parts) for k in range(parts)]
            start += s.ids
        return out or [Part(Shard(), 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.begin == partition.end:
            return
        disk, folder = _place(self.folder)
        shard = ShardFile(disk, f"{folder}/{partition.shard.file}")
        bounds = shard.boundaries.between(partition.begin, partition.end + 1)
        i = 0
        while i < len(bounds) - 1:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BATCH_BYTES // 4, "right")) - 1)
            ids = shard.ids(int(bounds[i]), int(bounds[j])).astype("<u4")
            places = pa.py_buffer((4 * (bounds[i : j + 1] - bounds[i])).astype(np.int32))
            column = pa.Array.from_buffers(pa.binary(), j - i, [None, places, pa.py_buffer(ids)])
            owners = shard.owners(partition.begin + i, partition.begin + j)
            yield pa.RecordBatch.from_arrays([owners, pa.array(bounds[i:j] + partition.start), pa.array(np.diff(bounds[i : j + 1])), column], ["id", "start", "n_tokens", "ids"])
            i = j


class TokenIds(DataSource):
    """Data source "token_ids": sorted documents' token ids in Elias-Fano indexed files, and those files as a table."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def encoded(docs: DataFrame, path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each text's token ids, unsigned 32-bit numbers, little-endian, with end_id after them; ascending ids, those without one last.

    Rows of one id are ordered by their texts' hashes. Texts move once, to ranges of ids, and are encoded where they arrive; the tokenizer adds no special tokens. Null text is empty, so that it gives end_id alone.
    Ids have to be whole numbers; repeated and null ids stay rows of their own. Other columns are not read; an empty table gives no rows.
    """
    if dict(docs.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} has to be a whole number")
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (part for batch in batches for part in slices(batch, 1, BATCH_BYTES)):
            flat, bounds = encoder(path).tokens(some.column(1), end_id)
            places = pa.py_buffer((4 * bounds).astype(np.int32))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.Array.from_buffers(pa.binary(), some.num_rows, [None, places, pa.py_buffer(flat.astype("<u4"))])], ["id", "ids"])

    return ranged.mapInArrow(lean(ids), "id long, ids binary")


def write(docs: DataFrame, folder: str, path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs and write their ids as "token_ids" in a new folder, which all executors must reach; ids take 2 bytes if the tokenizer's vocabulary lets them."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenIds)
    width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
    encoded(docs, path, end_id, id_col, text_col).write.format("token_ids").option("width", width).mode("append").save(folder)


def read(spark, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) of a folder that write() has filled: start counts the ids of all documents before."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").load(folder)


def document(folder: str, i: int) -> np.ndarray:
    """Ids of a folder's i-th document in order, without reading others."""
    shards = _Reader({"path": folder}).shards()
    before = [0, *np.cumsum([s.docs for s in shards]).tolist()]
    if not 0 <= i < before[-1]:
        raise IndexError(f"{i} of {before[-1]}")
    k = bisect.bisect_right(before, i) - 1
    disk, place = _place(folder)
    return ShardFile(disk, f"{place}/{shards[k].file}").document(i - before[k])


def new_folder(spark, name: str) -> str:
    """A folder below the one that all executors share; it goes when the application ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    disk = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    disk.mkdirs(hadoop)
    disk.deleteOnExit(hadoop)
    return folder
