"""Groups of exact and near copies: banded least names find families, differences from a family's centre find pairs, exact Jaccard decides, components join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ..functions import text as tx
from .cache import ContentCache
from .graph import components
from .rows import bounded_batches, keyed
from .stages import stage

#: 31-bit prime field of the permutations a * h + b, and of the numbers of shingles, polynomials of their characters in BASE.
PRIME, BASE = (1 << 31) - 1, 1_000_003
PERMUTATIONS, BAND_ROWS, SHINGLE = 128, 16, 5
#: Shingles whose values under all permutations are worked out at once, and bytes of texts that are Python strings together.
AT_ONCE, HELD = 512, 1 << 20
#: Ranges of names, of which a sketch takes the least each; members of a family that a slice has, about; members that tell its centre, at most, and their runs.
BINS, SLICE, TELLING, TOLD_BY = 128, 512, 16, 1 << 21
#: What a cache of sketches goes by: rows of another version are not read.
SIGNATURE_VERSION = f"bins-{BINS}-{BAND_ROWS}-{SHINGLE}-1"


def permutations(n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """Multipliers and offsets by rule: powers of two primitive roots modulo the prime."""
    return [(pow(7, 3 * i + 1, PRIME), pow(11, 5 * i + 2, PRIME)) for i in range(n)]


def exact_groups(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, md5, group_id): the smallest id of rows with the same bytes. Null texts count as empty; repeated and null ids stay rows of their own."""
    named = rows.select(id_col, content_key(F.col(text_col)).alias("md5"))
    return named.join(named.groupBy("md5").agg(F.min(id_col).alias("group_id")), "md5").select(id_col, "md5", "group_id")


def content_key(text: Column) -> Column:
    """The digest of a text's bytes, null as empty."""
    return F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def _points(packed: str) -> np.ndarray:
    return np.frombuffer(packed.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(points: np.ndarray) -> list[np.ndarray]:
    """The characters of each run of SHINGLE characters, by place in the run."""
    n = max(len(points) - SHINGLE + 1, 0)
    return [points[i : i + n] for i in range(SHINGLE)]


def names_of(packed: str) -> np.ndarray:
    """Distinct 64-bit names of the runs, in order: two halves of the characters, mixed. Runs that differ have different names but for one chance in 2^64."""
    c = [x.astype(np.uint64) for x in _runs(_points(packed))]
    left, right = c[0] | c[1] << np.uint64(21) | c[2] << np.uint64(42), c[3] | c[4] << np.uint64(21)
    x = left * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += right * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return np.unique(x)


def numbers_of(packed: str) -> np.ndarray:
    """Distinct numbers of the runs below the prime, in order: polynomials of their characters."""
    out = np.zeros(max(len(packed) - SHINGLE + 1, 0), np.int64)
    for x in _runs(_points(packed)):
        out = (out * BASE + x) % PRIME
    return np.unique(out)


_MULTIPLY, _ADD = (np.array(x, np.uint64) for x in zip(*permutations(), strict=True))


def least_of(numbers: np.ndarray) -> np.ndarray:
    """For each permutation the least value over the numbers; the prime of none."""
    least, numbers, prime, bits = np.full(PERMUTATIONS, PRIME, np.uint32), numbers.astype(np.uint64), np.uint64(PRIME), np.uint64(31)
    room = np.empty((2, min(AT_ONCE, len(numbers)), PERMUTATIONS), np.uint64)
    for at in range(0, len(numbers), AT_ONCE):
        some = numbers[at : at + AT_ONCE, None]
        x, upper = room[:, : len(some)]
        np.multiply(some, _MULTIPLY, out=x)
        x += _ADD
        # modulo 2^31 - 1: the upper bits are added to the lower ones; of what is below twice the prime, less the prime or not, the smaller one in 32 bits is left
        np.right_shift(x, bits, out=upper)
        x &= prime
        x += upper
        low = x.astype(np.uint32)
        np.minimum(low, low - np.uint32(PRIME), out=low)
        np.minimum(least, low.min(0), out=least)
    return least.astype(np.int64)


@F.arrow_udf(StructType().add("n", LongType()).add("first", StringType()))
def summary_of_runs(packed: pa.Array) -> pa.Array:
    """How many distinct runs there are, and the smallest by its characters."""
    n, first = [], []
    for x in packed:
        text = x.as_py() or ""
        c = _runs(_points(text))
        n.append(len(names_of(text)))
        if not len(c[0]):
            first.append(None)
            continue
        left = np.arange(len(c[0]))
        for part in c:
            left = left[part[left] == part[left].min()]
        first.append(text[left[0] : left[0] + SHINGLE])
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(first, pa.string())], ["n", "first"])


def signatures(rows: DataFrame, id_col: str, text_col: str, *more: str, counted: bool = True) -> DataFrame:
    """(id, *more, n, signature): how many distinct runs of five characters the text has, without white space and in lower case, and for each permutation the least value over them. n is null where it isn't asked for (counted).

    A text without runs has the prime everywhere, so that all such texts meet. Null text is empty.
    """
    names = [id_col, *more, "n", "signature"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = [], []
            for x in batch.column(batch.num_columns - 1):
                text = x.as_py()
                n.append(len(names_of(text)) if counted else None)
                out.append(least_of(numbers_of(text)))
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * PERMUTATIONS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), column], names)

    kinds = dict(rows.dtypes)
    given = bounded_batches(rows).select(id_col, *more, tx.packed(F.col(text_col)).alias("_packed"))
    return given.mapInArrow(signed, ", ".join(f"{c} {kinds[c]}" for c in (id_col, *more)) + ", n long, signature array<long>")


_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - (BINS - 1).bit_length())


def sketch_of(names: np.ndarray) -> np.ndarray:
    """A 64-bit name for each band of BAND_ROWS ranges: of the least names in them, 0 in an empty range."""
    begin = np.searchsorted(names, _EDGES)
    full = begin < np.append(begin[1:], len(names))
    least = np.zeros(BINS, np.uint64)
    least[full] = names[begin[full]]
    out = np.zeros(BINS // BAND_ROWS, np.uint64)
    for x in least.reshape(-1, BAND_ROWS).T:
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def sketches(rows: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, *more, n, bands): how many distinct runs of five characters the text has, without white space and in lower case, and the names of its bands.

    Two sets agree in a range with a chance of their Jaccard similarity, so that 8 bands of 16 miss a pair of 0.98 with a chance of 3 in 100,000; sets that differ in fewer runs than there are bands are never missed. Null text is empty.
    """
    names = [id_col, *more, "n", "bands"]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = [], [np.zeros(0, np.int64)]
            for x in batch.column(batch.num_columns - 1):
                runs = names_of(x.as_py())
                n.append(len(runs))
                out.append(sketch_of(runs))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (BINS // BAND_ROWS), pa.int32()), pa.array(np.concatenate(out)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), bands], names)

    kinds = dict(rows.dtypes)
    given = bounded_batches(rows).select(id_col, *more, tx.packed(F.col(text_col)).alias("_packed"))
    return given.mapInArrow(sketched, ", ".join(f"{c} {kinds[c]}" for c in (id_col, *more)) + ", n long, bands array<long>")


def near_groups(rows: DataFrame, id_col: str, text_col: str, label_col: str, threshold: float = 0.98, shingled_col: str | None = None, cache: ContentCache | None = None) -> DataFrame:
    """(id, group_id): exact copies join across labels, near copies of `threshold` or more within a label; all rows are kept, numbered densely from 0 by their smallest id. shingled_col: what near copies are told by, where that isn't the text itself; rows of equal text must have equal ones.

    Repeated and null ids stay rows of their own, null ones last in the order; a null label is a label. Links are sought between distinct texts of a label. Sketches, of a cache as far as it has them, place texts in buckets; texts that buckets join are a family.
    A family has a centre, the runs of more than half of a few of its members, and a member is told by its difference from the centre, which two members that differ in little share but for as little:
    |x ^ y| = |(x ^ c) ^ (y ^ c)|. So members whose differences have no run in common link only if both are near the centre, and then both link with the member nearest to it; all others that link share one of their rarest differences.
    Many copies that are near each other, but not so near as to link, thus don't meet pair by pair. Sets are compared whole, by 64-bit names.
    """
    shingled = shingled_col or text_col
    taken = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(F.col(label_col).alias("label")).alias("label"), F.col(shingled).alias("shingled"))
    taken, key = keyed(taken, "id", "text", "label")
    named = stage(taken.select("id", F.col(key).alias("key"), "label", content_key(F.col("text")).alias("md5"), content_key(F.col("shingled")).alias("sketched"), F.col("shingled").alias("text")), "named")
    if cache is None:
        signed = sketches(named, "key", "text", "md5", "label")
    else:
        known = cache.get(named.select(F.col("sketched").alias("key"), "text"), lambda missing: sketches(missing, "key", "text")).withColumnRenamed("key", "sketched")
        signed = named.select("key", "md5", "label", "sketched").join(known, "sketched").select("key", "md5", "label", "n", "bands")
    # digests and sketches meet by content; texts stay where they are but for those of families
    kinds = stage(signed.groupBy("md5", "label").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "kinds")
    links = _links(named.select(F.col("key").alias("rep"), "text"), kinds, threshold)
    first = named.groupBy("md5").agg(F.min("key").alias("b"))
    across = named.join(first, "md5").select(F.col("key").alias("a"), "b").where("a <> b")
    to_rep = named.join(kinds.select("md5", "label", F.col("rep").alias("b")), ["md5", "label"]).select(F.col("key").alias("a"), "b").where("a <> b")
    edges = across.unionByName(to_rep).unionByName(links)
    groups = stage(named.select("id", "key").join(components(edges), F.col("key") == F.col("node"), "left").select("id", F.coalesce("root", "key").alias("root")), "grouped")
    return groups.join(dense(groups.select("root").distinct(), "root", "group_id"), "root").select(F.col("id").alias(id_col), "group_id")


def _links(texts: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of `threshold` or more, so many that they join what all such pairs join."""
    bucket = ["label", "band", "bucket"]
    placed = signed.select("rep", "label", F.posexplode("bands").alias("band", "bucket"))
    shared = placed.groupBy(*bucket).agg(F.min("rep").alias("b"), F.count("*").alias("times")).where("times > 1").drop("times")
    families = components(placed.join(shared, bucket).where("rep <> b").select(F.col("rep").alias("a"), "b"), name="families")
    parts = families.groupBy("root").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("parts"))
    members = families.join(parts, "root").select(F.col("root").alias("family"), F.col("node").alias("rep"), "parts")
    telling = members.groupBy("family", F.pmod(F.xxhash64("rep"), F.lit(TELLING))).agg(F.min("rep").alias("rep")).select("rep", F.lit(True).alias("tells"))
    members = stage(members.join(telling, "rep", "left").withColumn("tells", F.coalesce("tells", F.lit(False))), "members")
    held = stage(_differences(texts, members, threshold), "differences")

    about = held.select("family", "rep", "n", F.size("differs").alias("d"), "least")
    weight = F.round(F.col("d") * (1 + threshold) - F.col("n") * (1 - threshold), 6)
    inmost = about.groupBy("family").agg(F.min(F.struct(weight.alias("weight"), "rep", "n", "d")).alias("to"))
    lists = stage(about.select("family", "rep", "n", "d", F.explode("least").alias("run")), "lists")
    many = lists.groupBy("family", "run").agg(F.min(F.struct("rep", "n", "d")).alias("one"), F.min_by(F.struct("rep", "n", "d"), F.xxhash64("rep")).alias("two"), F.count("*").alias("times")).where("times > 1")
    lists = stage(lists.join(many, ["family", "run"]), "shared")
    led = about.join(inmost, "family").select("rep", "n", "d", F.struct("to.rep", "to.n", "to.d").alias("to")).unionByName(lists.select("rep", "n", "d", F.explode(F.array("one", "two")).alias("to")))
    led = led.where("rep <> to.rep").where(_may(F.col("n"), F.col("to.n"), F.col("d"), F.col("to.d"), threshold))
    tried = stage(led.select(F.greatest("rep", "to.rep").alias("a"), F.least("rep", "to.rep").alias("b")).distinct(), "tried")
    links = stage(_alike(held, tried, threshold), "links")

    rows = lists.join(components(links), F.col("rep") == F.col("node"), "left").select("family", "run", "rep", "n", "d", F.coalesce("root", "rep").alias("comp"))
    mixed = rows.groupBy("family", "run").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("family", "run")
    rows = stage(rows.join(mixed, ["family", "run"]), "mixed")
    other = rows.select("family", "run", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("d").alias("e"), F.col("comp").alias("comp2"))
    met = rows.withColumnRenamed("rep", "a").join(other, ["family", "run"]).where((F.col("a") > F.col("b")) & (F.col("comp") != F.col("comp2")) & _may(F.col("n"), F.col("m"), F.col("d"), F.col("e"), threshold))
    rest = met.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    return links.unionByName(stage(_alike(held, rest, threshold), "links"))


def _may(n: Column, m: Column, d: Column, e: Column, threshold: float) -> Column:
    """Sets of n and m runs, of which d and e differ from the centre, may be alike: the sizes are, and the differences are of sizes that are."""
    return (F.least(n, m) >= F.lit(threshold) * F.greatest(n, m)) & (F.abs(d - e) * (1 + threshold) <= (n + m) * (1 - threshold) + 1e-6)


def _alike(held: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of one family that are of `threshold` or more, by their differences from its centre. Sets without runs are alike."""
    one, two = held.select(F.col("rep").alias("a"), "n", F.col("differs").alias("x")), held.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("differs").alias("y"))
    apart = F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))
    both = (F.col("n") + F.col("m") - apart) / 2
    return pairs.join(one, "a").join(two, "b").where(both >= F.lit(threshold) * (F.col("n") + F.col("m") - both)).select("a", "b")


def _differences(texts: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(family, rep, n, differs, least): the runs in which a member differs from the centre of its family, and so many of the rarest of them that members which link and have any in common have one of these in common.

    Large families come in slices, each with the members that tell the centre; these are the only texts held at once. Members grow with the table and are never broadcast.
    """
    slot = F.pmod(F.xxhash64("rep", F.lit(1)), "parts").cast("int")
    own = members.select("family", slot.alias("slot"), (F.col("tells") & (F.col("parts") == 1)).alias("tells"), F.lit(True).alias("counts"), "rep")
    lent = members.where("tells and parts > 1").select("family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slot"), "tells", F.lit(False).alias("counts"), "rep")
    rows = own.unionByName(lent).hint("merge").join(texts.select("rep", tx.packed(F.col("text")).alias("text")), "rep").select("family", "slot", "tells", "counts", "rep", "text")
    sliced = bounded_batches(rows).repartition("family", "slot").sortWithinPartitions("family", "slot", F.desc("tells"), "rep")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, centre, out = None, [], None, _Differences(threshold)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            for *where, tells, counts, rep, text in zip(*columns, batch.column(batch.num_columns - 1), strict=True):
                if where != at or not tells:
                    centre = out.close(at, waiting) if waiting else centre
                    waiting = []
                at = where
                if tells:
                    waiting.append((rep, counts, text.as_py()))
                else:
                    out.add(at[0], rep, names_of(text.as_py()), centre)
                if out.held >= HELD:
                    yield out.batch()
        if waiting:
            out.close(at, waiting)
        yield out.batch()

    return sliced.mapInArrow(told, "family long, rep long, n long, differs array<long>, least array<long>")


class _Differences:
    """Rows of differences as they are found."""

    def __init__(self, threshold: float):
        self.threshold, self.held, self.rows = threshold, 0, []

    def close(self, at: list, waiting: list[tuple[int, bool, str]]) -> tuple[np.ndarray, ...]:
        """The centre that the waiting members tell, so many of them as TOLD_BY runs allow: its runs, and how many members differ from it in which run. Members that count become rows."""
        sets, total = [], 0
        for _, _, text in waiting:
            if sets and total + len(text) > TOLD_BY:
                break
            sets.append(names_of(text))
            total += len(text)
        runs, times = np.unique(np.concatenate(sets), return_counts=True)
        most = times * 2 > len(sets)
        centre = runs[most], runs, np.where(most, len(sets) - times, times)
        for i, (rep, counts, text) in enumerate(waiting):
            if counts:
                self.add(at[0], rep, sets[i] if i < len(sets) else names_of(text), centre)
        return centre

    def add(self, family: int, rep: int, names: np.ndarray, centre: tuple[np.ndarray, ...]) -> None:
        common, runs, times = centre
        differs = np.setxor1d(names, common, assume_unique=True)
        place = np.searchsorted(runs, differs)
        known = place < len(runs)
        known[known] = runs[place[known]] == differs[known]
        rarity = np.zeros(len(differs), np.int64)
        rarity[known] = times[place[known]]
        # what a member lacks is one of the centre's few runs, what it adds one of very many
        lacks = ~np.isin(differs, names, assume_unique=True)
        few = int(len(names) * (1 - self.threshold) / self.threshold + 1e-9) + 1
        least = differs[np.lexsort((differs, lacks, rarity))[:few]]
        self.rows.append((family, rep, len(names), differs.view(np.int64), least.view(np.int64)))
        self.held += 16 * (len(differs) + 4)

    def batch(self) -> pa.RecordBatch:
        family, rep, n, differs, least = ([x[i] for x in self.rows] for i in range(5))
        self.rows, self.held = [], 0

        def lists(parts: list[np.ndarray]) -> pa.Array:
            ends = np.cumsum([0, *map(len, parts)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (family, rep, n)), lists(differs), lists(least)], ["family", "rep", "n", "differs", "least"])


def dense(rows: DataFrame, order_col: str, out: str) -> DataFrame:
    """Numbers from 0 by a unique column, in parallel ranges."""
    ranged = stage(rows.repartitionByRange(F.col(order_col)).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    bases = sizes.withColumn("base", F.sum("n").over(Window.orderBy("_part")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order_col)) - 1
    return ranged.join(F.broadcast(bases), "_part").withColumn(out, (F.col("base") + inside).cast("long")).drop("_part", "base")
