"""A prefix trie over conversations by burst tries: containers of suffixes under trie heads, of which oversized ones burst by their next turn."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType

from .common import lean, stage

#: Turns that a container may hold before it bursts; bytes of sequences that a task gathers before it passes them on.
MOST, HELD = 2048, 4 << 20
#: Conversations of one block take their first turns from one of them; turns that are taken from it at most.
BLOCK, SHARED = 100, 5
#: Bytes of a turn's name.
NAME = 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PLACED = f"{_NODE}, top boolean, above binary, round int"


def _columns(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def sequences(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(path, chars, n, conv, ends): each distinct sequence of rebuilt turns once, with its conversations' number, their smallest id, and the digest of their ids.

    path holds the turns' 16-byte names one after another, chars their texts' code points as 32-bit numbers, ends the SHA-256 of the ids in numerical order, comma-joined. Turns go by turn (null first), ties by their names;
    null role or text is empty; rows without an id belong to no conversation. Blocks of conversations lie in ranges of ids, so that each task sees runs of ids; equal sequences are counted in the task first, and ids go on
    as joined runs, which are hashed in order as they stream by: however many conversations are equal, no task holds all their ids.
    """
    role, text, conv = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")), F.col(id_col).cast("long")
    turns = conversations.where(conv.isNotNull()).select(
        (conv - conv % BLOCK).alias("base"),
        conv.alias("conv"),
        F.col("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("name"),
        F.length(text).alias("chars"),
    )
    ordered = turns.repartitionByRange("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.col("turn").asc_nulls_first(), "name").select("base", "conv", "name", "chars")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(base, conversation, path, chars) in the order of rows."""
        base = conv = None
        names, chars, first = bytearray(), bytearray(), (b"", b"")

        def ended() -> tuple[int, int, bytes, bytes]:
            nonlocal first
            if conv == base:
                first = bytes(names[: SHARED * NAME]), bytes(chars[: SHARED * 4])
            h = zlib.crc32(str(conv).encode()) % (SHARED + 1)
            return base, conv, first[0][: h * NAME] + bytes(names[h * NAME :]), first[1][: h * 4] + bytes(chars[h * 4 :])

        for batch in batches:
            if not batch.num_rows:
                continue
            of, blocks = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            data, lengths = b"".join(batch.column(2).to_pylist()), batch.column(3).to_numpy().astype("<i4").tobytes()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if of[a] != conv:
                    if conv is not None:
                        yield ended()
                    if blocks[a] != base:
                        first = b"", b""
                    base, conv = int(blocks[a]), int(of[a])
                    names.clear(), chars.clear()
                names += data[a * NAME : b * NAME]
                chars += lengths[a * 4 : b * 4]
        if conv is not None:
            yield ended()

    kinds, fields = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()], ["path", "chars", "n", "conv", "ids"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = {}, 0, None

        def out() -> pa.RecordBatch:
            return _columns([(path, chars, len(ids), min(ids), ",".join(map(str, sorted(ids))).encode()) for path, (chars, ids) in held.items()], kinds, fields)

        for base, conv, path, chars in rebuilt(batches):
            if base != last and size > HELD:  # between blocks, so that runs of ids don't overlap
                yield out()
                held, size = {}, 0
            last = base
            known = held.get(path)
            if known is None:
                held[path] = known = (chars, [])
                size += len(path) + len(chars)
            known[1].append(conv)
            size += NAME
        if held:
            yield out()

    runs = ordered.mapInArrow(lean(counted), "path binary, chars binary, n long, conv long, ids binary")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, size = None, [], 0
        for batch in batches:
            for path, chars, n, conv, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or path != now[0]:
                    if now is not None:
                        rows.append((*now[:4], now[4].hexdigest()))
                        size += len(now[0])
                    now = [path, chars, 0, conv, hashlib.sha256()]
                elif now[2]:
                    now[4].update(b",")
                now[2] += n
                now[4].update(ids)
                if size > HELD or len(rows) > 10_000:
                    yield _columns(rows, [*kinds[:4], pa.string()], [*fields[:4], "ends"])
                    rows, size = [], 0
        if now is not None:
            rows.append((*now[:4], now[4].hexdigest()))
        if rows:
            yield _columns(rows, [*kinds[:4], pa.string()], [*fields[:4], "ends"])

    return runs.repartition("path").sortWithinPartitions("path", "conv").mapInArrow(lean(joined), "path binary, chars binary, n long, conv long, ends string")


def _shared(a: bytes, b: bytes, start: int) -> int:
    """Turns that two paths have in common, of which the first `start` are."""
    most = min(len(a), len(b)) // NAME
    while start < most and a[start * NAME : (start + 1) * NAME] == b[start * NAME : (start + 1) * NAME]:
        start += 1
    return start


@F.pandas_udf(IntegerType())
def _common(lo: pd.Series, hi: pd.Series) -> pd.Series:
    return pd.Series([_shared(a, b, 0) for a, b in zip(lo, hi, strict=True)], dtype="int32")


def _burst(rows: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """(closed rows, heads, rows that end at a head) by round. Each row lies in the container of its first `top` turns.

    A container with more turns below than `most` becomes a head at the last turn that all its rows share, and bursts by the turn after it, so that a long common beginning is one step; sizes are aggregated before they move.
    """
    prefix = F.expr(f"substring(path, 1, {NAME} * top)")
    closed, heads, ends, left = [], [], [], rows.withColumn("top", F.lit(0))
    while True:
        sizes = left.groupBy("top", prefix.alias("prefix")).agg(F.sum(F.octet_length("path") / NAME - F.col("top") + 1).alias("size"), F.min(F.struct("path", "chars")).alias("lo"), F.max("path").alias("hi"))
        over = sizes.where(F.col("size") > most).withColumn("k", _common("lo.path", "hi"))
        found = stage(over.select("top", "prefix", "k", F.expr(f"substring(lo.path, 1, {NAME} * k)").alias("head"), F.expr("substring(lo.chars, 1, 4 * k)").alias("chars")), "trie-heads")
        if found.isEmpty():
            return [*closed, left], heads, ends
        dealt = stage(left.withColumn("prefix", prefix).join(found.select("top", "prefix", "k"), ["top", "prefix"], "left").drop("prefix"), "trie-rows")
        heads.append(found)
        closed.append(dealt.where("k is null").drop("k"))
        ends.append(dealt.where(f"octet_length(path) = {NAME} * k").drop("k", "top"))
        left = dealt.where(f"octet_length(path) > {NAME} * k").withColumn("top", F.col("k") + 1).drop("k")


def _swept(rows: list[tuple[bytes, bytes, int, int, str]], top: int, at: int) -> list[list]:
    """The nodes of a container from depth `top` on; rows are (path, chars, n, conv, ends) in the order of paths."""
    out, open_nodes, before = [], [], b""

    def close() -> None:
        depth, n, conv, children, leaves, saved, ends, chars, below = open_nodes.pop()
        saved += (n - 1) * chars
        for i in below:
            out[i][2] = conv
        leaves = leaves or 1
        above = open_nodes[-1] if open_nodes else None
        if above:
            above[1], above[2], above[3], above[4], above[5] = above[1] + n, min(above[2], conv), above[3] + 1, above[4] + leaves, above[5] + saved
            above[8].append(len(out))
        head = rows[0][0][: (top - 1) * NAME] if not above and top else None
        out.append([conv, depth, None, n, children, leaves, saved, ends, not above, head, at])

    for path, chars, n, conv, ends in rows:
        depth = _shared(before, path, top) if open_nodes else top - 1
        while open_nodes and open_nodes[-1][0] > depth:
            close()
        lengths = np.frombuffer(chars, "<i4").tolist()
        for d in range(depth + 1, len(path) // NAME + 1):
            open_nodes.append([d, 0, conv, 0, 0, 0, _NO_ENDS, lengths[d - 1] if d else 0, []])
        last = open_nodes[-1]
        last[1], last[2], last[6] = last[1] + n, min(last[2], conv), ends
        before = path
    while open_nodes:
        close()
    return out


_NODE_TYPES = [pa.int64()] * 7 + [pa.string(), pa.bool_(), pa.binary(), pa.int32()]
_NODE_NAMES = [x.split()[0] for x in _PLACED.split(", ")]


def _sweep(closed: list[DataFrame]) -> DataFrame:
    """Nodes of all containers; a container's rows are sorted, and it is swept when the next one begins."""
    rows = reduce(DataFrame.unionByName, [x.withColumn("round", F.lit(i)) for i, x in enumerate(closed)])
    columns = ["path", "chars", "n", "conv", "ends", "top", "round"]

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for *row, top, at in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                key = top, at, row[0][: top * NAME]
                if key != now and held:
                    out += _swept(held, *now[:2])
                    held = []
                    if len(out) > 10_000:
                        yield _columns(out, _NODE_TYPES, _NODE_NAMES)
                        out = []
                now = key
                held.append(row)
        if held:
            out += _swept(held, *now[:2])
        if out:
            yield _columns(out, _NODE_TYPES, _NODE_NAMES)

    dealt = rows.select(*columns).repartition("top", F.expr(f"substring(path, 1, {NAME} * top)")).sortWithinPartitions("path")
    return dealt.mapInArrow(lean(nodes), _PLACED)


def _chains(heads: DataFrame, at: int) -> DataFrame:
    """Nodes of heads and of the turns between them and the heads above, all of which have the same conversations; heads are (top, k, head, chars) with what is below added up."""
    columns = ["top", "k", "head", "chars", "n", "conv", "leaves", "saved", "children", "ends"]

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, k, head, chars, n, conv, leaves, saved, children, ends in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                own = np.concatenate([[0], np.frombuffer(chars, "<i4")]).astype(np.int64)[top:]
                sums = saved + (n - 1) * np.cumsum(own[::-1])[::-1]
                for a in range(top, k + 1, 10_000):
                    rows = [(conv, d, conv if d > top else None, n, children if d == k else 1, max(leaves, 1), int(sums[d - top]), ends or _NO_ENDS if d == k else _NO_ENDS, d == top, head[: (top - 1) * NAME] if d == top > 0 else None, at) for d in range(a, min(k + 1, a + 10_000))]
                    yield _columns(rows, _NODE_TYPES, _NODE_NAMES)

    return heads.select(*columns).mapInArrow(nodes, _PLACED)


def prefix_nodes(conversations: DataFrame, most: int = MOST, id_col: str = "conv_id") -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations, from the textless root on.

    Every conversation c is rebuilt: the first h turns of conversation c - c % 100 (none if it is absent), then its own turns after its first h; h is crc32 of its decimal id modulo 6. conv_id is the smallest of the conversations that
    begin with the sequence and n_convs their number; parent_conv_id is the parent's conv_id (root: null); n_leaves counts childless nodes of the subtree; saved_tokens adds up, over the subtree, (n_convs - 1) times the code points
    of the last turn's text; ends_sha256 is the digest of the conversations that are exactly the sequence.

    Sequences are made once and equal ones merged; containers under heads then burst until each holds at most `most` turns, and are sorted and swept into nodes by many tasks; heads are added up from their containers, round by round from
    below. So no task holds more than a container, or a conversation. See sequences() for nulls and ties; rows without an id make no node, an empty table gives no rows, and other columns are not read.
    """
    if most < 1:
        raise ValueError("a container holds a turn at least")
    rows = stage(sequences(conversations, id_col), "trie-sequences")
    closed, heads, ends = _burst(rows, most)
    placed, parents = [stage(_sweep(closed), "trie-nodes")], []
    for i in reversed(range(len(heads))):
        below = placed[0].where((F.col("round") == i + 1) & F.col("top"))
        if len(placed) > 1:
            below = below.unionByName(placed[-1].where("top"))
        parts = below.select(F.col("above").alias("head"), F.col("n_convs").alias("n"), F.col("conv_id").alias("conv"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(1).alias("child"), F.lit(None).cast("string").alias("ends"))
        zero = F.lit(0).cast("long")
        parts = parts.unionByName(ends[i].select(F.col("path").alias("head"), "n", "conv", zero.alias("leaves"), zero.alias("saved"), F.lit(0).alias("child"), "ends"))
        sums = parts.groupBy("head").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("child").alias("children"), F.max("ends").alias("ends"))
        summed = stage(heads[i].join(sums, "head"), "trie-sums")
        placed.append(stage(_chains(summed, i), "trie-nodes"))
        parents.append(summed.select(F.col("head").alias("above"), F.col("conv").alias("parent")))
    nodes = reduce(DataFrame.unionByName, placed)
    names = [x.split()[0] for x in _NODE.split(", ")]
    inner = nodes.where("above is null").select(*names)
    if not parents:
        return inner
    tops = nodes.where("above is not null").drop("parent_conv_id").join(reduce(DataFrame.unionByName, parents), "above").withColumnRenamed("parent", "parent_conv_id")
    return inner.unionByName(tops.select(*names))
