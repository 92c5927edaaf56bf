"""Exact n-gram Jaccard join and its connected groups, by an inverted index with skipping from set relations.

Each distinct set enters the index with its prefix in a global order (rare shingles first): two sets over the threshold share a prefix shingle.
An index list is cut into blocks by size, each block knows its lowest position, and a set skips the blocks whose positions or sizes rule out the overlap it needs.
Answers are derived from similar sets' answers: sets are first checked against the leading set of their blocks; a set linked to another follows it, takes over its group, and lists and pairs inside one
group are never visited again. What is left are pairs of different groups. Only the pairs of sets that they follow are computed; a follower's overlap differs from that of its leader by what
the two sets differ in at most, on either side, which settles most pairs; the others are checked in full, so that no link between groups is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .bytehash import names, pair
from .common import components, keyed, lean, slices, stage

_LOWER = np.array([*range(65), *range(97, 123), *range(91, 256)], np.uint8)
_LETTERS = names(_LOWER, 1)[0]
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)]).astype(np.int8)
#: One document in so many is read to find frequent shingles; so many of them are told to every task. They only shape the order.
SAMPLE, FREQUENT = 32, 1 << 17
#: Ids that may be broadcast, about 8 bytes each; beyond, the join shuffles.
FEW = 500_000
#: Bytes of text whose sets are held together.
HELD = 1 << 22

_CHUNK = 1 << 18
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ROOT), -1, 1 << 64))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.full(n, 1, np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = _ROOT, _BACK
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words in data (bytes that begin and end with white space) and the names of their bytes, A-Z in lower case."""
    edge = np.flatnonzero(np.diff(_SPACE[data]))
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    up, down = _powers(1 << max(18, int(len(data)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * up[: len(data)])])
    return starts, pair((sums[ends] - sums[starts]) * down[starts], (ends - starts).astype(np.uint64))


def _words_of(text: bytes) -> np.ndarray:
    """Names of the words of one long text, in pieces cut at white space."""
    got, at = [], 0
    while at < len(text):
        cut = _BREAK.search(text, at + _CHUNK)
        end = cut.start() if cut else len(text)
        got.append(_word_names(np.frombuffer(b" " + text[at:end] + b" ", np.uint8))[1])
        at = end
    return np.concatenate(got)


def _shingled(w: np.ndarray, words: int) -> np.ndarray:
    name = w[: max(len(w) - words + 1, 0)]
    for k in range(1, words):
        name = pair(name, w[k : k + len(name)])
    return name


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle names of each text; a text of fewer words than a shingle has its whole sequence as its one shingle, one without words none."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        if len(texts[at]) > _CHUNK:
            w = _words_of(texts[at])
            out.append(np.unique(_shingled(w, words)) if len(w) >= words else _few(w))
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and (not size or size + len(texts[end]) < _CHUNK):
            size += len(texts[end]) + 1
            end += 1
        some = texts[at:end]
        bounds = np.cumsum([0, *(len(x) + 1 for x in some)])
        starts, w = _word_names(np.frombuffer(b" " + b" ".join(some) + b" ", np.uint8))
        cuts = np.searchsorted(starts, bounds + 1)
        name = _shingled(w, words)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out.append(np.unique(name[a : b - words + 1]) if b - a >= words else _few(w[a:b]))
        at = end
    return out


def _few(w: np.ndarray) -> np.ndarray:
    """The one shingle of a text of fewer words than a shingle has, none of none."""
    whole = w[:1]
    for k in range(1, len(w)):
        whole = pair(whole, w[k : k + 1])
    return pair(whole, np.array([len(w)], np.uint64)) if len(w) else whole


def parity(s: np.ndarray) -> bytes:
    """For each of at least as many classes of shingles as the set has, in a power of two, whether it holds an odd number: an eighth of a byte a shingle, about."""
    classes = 1 << max(10, len(s).bit_length())
    odd = np.bincount((s >> np.uint64(24)).astype(np.int64) & (classes - 1), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(one: bytes, other: bytes) -> int:
    """A number of shingles that two sets differ in at least."""
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def jaccard_groups(docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per document.

    Documents link when 100 * intersection >= percent * union of their sets of distinct word shingles (A-Z in lower case, words parted by ASCII white space); component_id is the smallest id that links reach.
    Null or empty text has no shingles and links with nothing. Rows equal in text have equal sets and so one group; repeated ids stay repeated rows, null ids sort last. No rows come of an empty table; other columns are not read.
    """
    docs = keyed(docs, id_col, text_col)
    sets = stage(docs.mapInArrow(lean(_described(words)), f"key long, id {dict(docs.dtypes)['id']}, n long, print binary, odd binary"), "sets")
    kinds = stage(sets.where("n > 0").groupBy("print").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("odd").alias("odd")), "kinds")
    index = _index(docs, kinds, percent, words)
    links = None
    for turn in (1, 2):
        found = _linked(docs, kinds, _leading(index, links, turn, percent), percent, words)
        links = found if links is None else links.unionByName(found)
    rest = _answered(docs, kinds, links, _across(index, links, percent), percent, words)
    groups = components(links.select("a", "b").unionByName(rest))
    roots = kinds.join(groups, F.col("rep") == F.col("node"), "left").select("print", F.coalesce("root", "rep").alias("root"))
    named = sets.join(roots, "print", "left").select("id", "n", F.coalesce("root", "key").alias("root"))
    first = sets.select(F.col("key").alias("root"), F.col("id").alias("component_id"))
    return named.join(first, "root").select("id", F.col("n").alias("n_shingles"), "component_id")


def _described(words: int):
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, HELD)):
            sets = shingle_sets([x.as_buffer().to_pybytes() for x in batch.column(2)], words)
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.binary()), pa.array(map(parity, sets), pa.binary())], ["key", "id", "n", "print", "odd"])

    return described


def _shingles(words: int):
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, HELD)):
            sets = shingle_sets([x.as_buffer().to_pybytes() for x in batch.column(1)], words)
            token, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    return shingles


def _prefixes(percent: int, words: int, tokens: np.ndarray, counts: np.ndarray):
    """Prefix rows; a shingle that a batch holds more than once is known to be shared, and only its first row waits at the shingle's own place for other batches."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, HELD)):
            got: list[tuple] = []
            least: dict[bytes, int] = {}
            keys = batch.column(0).to_pylist()
            sets = shingle_sets([x.as_buffer().to_pybytes() for x in batch.column(1)], words)
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            for key, mark in zip(keys, prints, strict=True):
                least[mark] = min(key, least.get(mark, key))
            for key, mark, s in zip(keys, prints, sets, strict=True):
                if not len(s) or key > least[mark]:  # of equal sets only the smallest key can stand for them
                    continue
                at = np.minimum(np.searchsorted(tokens, s), max(len(tokens) - 1, 0))
                often = np.where(tokens[at] == s, counts[at], 0) if len(tokens) else np.zeros(len(s), np.int64)
                p = len(s) - -(-percent * len(s) // 100) + 1
                order = np.lexsort((s, often))[:p]
                got.append((s[order], np.full(p, key), np.full(p, len(s)), np.arange(p)))
            if not got:
                continue
            token, key, n, pos = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(token, kind="stable")
            token, key, n, pos = token[order], key[order], n[order], pos[order]
            new = np.concatenate([[True], token[1:] != token[:-1]])
            shared = (np.bincount(np.cumsum(new) - 1) > 1)[np.cumsum(new) - 1]
            slot = np.where(new, token, pair(token, key.astype(np.uint64)))
            cols = [slot.view(np.int64), token.view(np.int64), key, n << 33 | pos << 1 | shared]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["slot", "token", "key", "at"])

    return prefixes


def _index(docs: DataFrame, kinds: DataFrame, percent: int, words: int) -> DataFrame:
    """Index rows (token, key, n, pos, block, prev) of shingles that at least two distinct sets have in their prefixes. prev: the set's previous such shingle."""
    text = docs.select("key", "text")
    often = text.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).mapInArrow(lean(_shingles(words)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = often.where("n > 1").orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas().to_numpy(np.int64)
    tokens = top[:, 0].view(np.uint64) if len(top) else np.zeros(0, np.uint64)
    order = np.argsort(tokens)
    rows = text.mapInArrow(lean(_prefixes(percent, words, tokens[order], top[order, 1] if len(top) else np.zeros(0, np.int64))), "slot long, token long, key long, at long")
    shared = (F.expr("at & 1") == 1) | (F.count("*").over(Window.partitionBy("slot")) > 1)
    met = rows.withColumn("shared", shared).where("shared").select("token", "key", F.expr("cast(shiftright(at, 33) as int)").alias("n"), F.expr("cast(shiftright(at, 1) & 4294967295 as int)").alias("pos"))
    met = stage(met, "met").join(kinds.select(F.col("rep").alias("key")), "key", "left_semi")
    lists = met.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1").select("token")
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    kept = met.join(lists, "token").withColumn("prev", F.lag("token").over(Window.partitionBy("key").orderBy("pos"))).withColumn("block", block)
    return stage(kept, "index")


def _able(n, i, m, j, percent: int):
    """Sizes n and m allow a link, and so do the shingles from positions i and j on, if these are the first that the sets share."""
    sizes = (F.least(n, m) * 100 >= F.greatest(n, m) * percent)
    return sizes & (F.least(n - i, m - j) * (100 + percent) >= (n + m) * percent)


def _grouped(index: DataFrame, links: DataFrame | None) -> DataFrame:
    """Index rows with their set's group, of the lists that more than one group is on."""
    if links is None:
        return index.withColumn("comp", F.col("key"))
    groups = components(links.select("a", "b"))
    comp = index.join(groups, F.col("key") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "key")).drop("node", "root")
    mixed = comp.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("token")
    return stage(comp.join(mixed, "token"), "grouped")


def _leading(index: DataFrame, links: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """Pairs of a set and a leading set of its block or the one below: first the set that has the shingle earliest, then one at random."""
    rows = _grouped(index, links)
    first = F.col("pos").cast("long") if turn == 1 else F.xxhash64("key", "token")
    lead = rows.groupBy("token", "block").agg(F.min(F.struct(first.alias("by"), "key", "n", "pos", "comp")).alias("lead"))
    probes = rows.withColumn("block", F.explode(F.array("block", F.col("block") - 1)))
    hit = probes.join(lead, ["token", "block"]).where(F.col("comp") != F.col("lead.comp"))
    hit = hit.where(_able(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos"), percent))
    return hit.select(F.least("key", "lead.key").alias("a"), F.greatest("key", "lead.key").alias("b")).distinct()


def _across(index: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets of different groups that the index can't rule out."""
    rows = _grouped(index, links)
    blocks = rows.groupBy("token", "block").agg(F.min("pos").alias("low"), F.min("n").alias("small"), F.max("n").alias("large"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    probes = rows.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") - 1)))
    n, i = F.col("n"), F.col("pos")
    visit = (F.least(n - i, F.col("large") - F.col("low")) * (100 + percent) >= (n + F.col("small")) * percent) & ((F.col("c0") != F.col("comp")) | (F.col("c1") != F.col("comp")))
    visits = probes.join(blocks, ["token", "block"]).where(visit).select("token", "block", "key", "n", "pos", "comp", "prev")
    other = rows.select("token", "block", *(F.col(x).alias(f"{x}2") for x in ("key", "n", "pos", "comp", "prev")))
    fresh = ~F.coalesce(F.col("prev") == F.col("prev2"), F.lit(False))  # with the same shingle before this one, they meet there
    on = (visits["token"] == other["token"]) & (visits["block"] == other["block"]) & (F.col("comp") != F.col("comp2")) & fresh & _able(n, i, F.col("n2"), F.col("pos2"), percent)
    return visits.join(other, on).select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()


def _near(kinds: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, nx, ny, extra) of the pairs (a, b, extra), written, that parities leave: a link needs so few differences, or, with extra, a link of sets that differ from a and b in up to extra shingles."""
    pairs = pairs.join(kinds.select(F.col("rep").alias("a"), F.col("n").alias("nx"), F.col("odd").alias("x")), "a")
    pairs = pairs.join(kinds.select(F.col("rep").alias("b"), F.col("n").alias("ny"), F.col("odd").alias("y")), "b").select("a", "b", "nx", "ny", "extra", "x", "y")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = np.array([apart(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(5), batch.column(6), strict=True)], np.int64)
            sizes, extra = batch.column(2).to_numpy() + batch.column(3).to_numpy(), batch.column(4).to_numpy()
            # with d differences between two sets of s shingles together, (s - d) / 2 are shared; sets that follow them share up to extra more, and hold up to extra less
            yield batch.select(["a", "b", "nx", "ny", "extra"]).filter(pa.array((differ - 2 * extra) * (100 + percent) <= sizes * (100 - percent) + 2 * percent * extra))

    return stage(pairs.mapInArrow(lean(near), "a long, b long, nx long, ny long, extra long"), "pairs")


def _shared(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b, *more), a written table, with the number of shingles that the whole sets share (both)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (part for batch in batches for part in slices(batch, 1, HELD)):
            sets = shingle_sets([x.as_buffer().to_pybytes() for x in some.column(1)], words)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "shingles"])

    sets = docs.select("key", "text").join(wanted, "key", "left_semi").mapInArrow(lean(whole), "key long, shingles array<long>")
    one, two = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select(*pairs.columns, F.size(F.array_intersect("x", "y")).cast("long").alias("both"))


def _links(n, m, both, percent: int):
    return both * (100 + percent) >= (n + m) * percent


def _linked(docs: DataFrame, kinds: DataFrame, pairs: DataFrame, percent: int, words: int) -> DataFrame:
    """(a, b, nx, ny, both) of the pairs (a, b) whose sets link, by their whole sets. Pairs whose parities alone show too many differences go first, without their sets."""
    both = _shared(docs, _near(kinds, pairs.withColumn("extra", F.lit(0).cast("long")), percent), words)
    return stage(both.where(_links(F.col("nx"), F.col("ny"), F.col("both"), percent)).drop("extra"), "links")


def _answered(docs: DataFrame, kinds: DataFrame, links: DataFrame, pairs: DataFrame, percent: int, words: int) -> DataFrame:
    """(a, b) of the pairs (a, b) that link, derived from the overlaps of the sets that a and b follow.

    A set follows the one it shares most with, of those it is linked to with a smaller key, or itself. With x followed by a and y by b: what a shares with b is what x shares with y, and at most
    what a and b have beyond x and y more, or what x and y have beyond a and b less. Where that doesn't tell, a and b are compared by their whole sets.
    """
    leads = links.groupBy(F.col("b").alias("s")).agg(F.max_by(F.struct("a", "nx", "ny", "both"), F.struct("both", -F.col("a"))).alias("to")).select("s", "to.*")
    follows = leads.select("s", F.col("a").alias("head"), (F.col("ny") - F.col("both")).alias("beyond"), (F.col("nx") - F.col("both")).alias("lacks"))
    for side in ("a", "b"):
        of = follows.select(*(F.col(c).alias(f"{c}_{side}") for c in follows.columns))
        pairs = pairs.join(of, F.col(side) == F.col(f"s_{side}"), "left").withColumns({f"head_{side}": F.coalesce(f"head_{side}", side), f"beyond_{side}": F.coalesce(f"beyond_{side}", F.lit(0)), f"lacks_{side}": F.coalesce(f"lacks_{side}", F.lit(0))})
    size = kinds.select("rep", "n")
    pairs = pairs.join(size.select(F.col("rep").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("rep").alias("b"), F.col("n").alias("n_b")), "b")
    heads = {"x": F.least("head_a", "head_b"), "y": F.greatest("head_a", "head_b")}
    pairs = stage(pairs.select("a", "b", "n_a", "n_b", (F.col("beyond_a") + F.col("beyond_b")).alias("beyond"), (F.col("lacks_a") + F.col("lacks_b")).alias("lacks"), *(c.alias(k) for k, c in heads.items())), "led")
    asked = pairs.where("x < y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.max(F.col("beyond") + F.col("lacks")).alias("extra"))
    answers = stage(_shared(docs, _near(kinds, asked, percent), words).select(F.col("a").alias("x"), F.col("b").alias("y"), "both"), "answers")
    # what one set shares with itself is all of it; head pairs that parities ruled out have no follower that links
    own = kinds.select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.col("n").alias("both"))
    known = pairs.join(answers, ["x", "y"]).unionByName(pairs.where("x = y").join(own, ["x", "y"]))
    n, m, both = F.col("n_a"), F.col("n_b"), F.col("both")
    known = known.where(_links(n, m, both + F.col("beyond"), percent)).withColumn("sure", _links(n, m, both - F.col("lacks"), percent))
    known = stage(known.select("a", "b", "sure"), "derived")
    return known.where("sure").select("a", "b").unionByName(_linked(docs, kinds, known.where("not sure").select("a", "b"), percent, words).select("a", "b"))
