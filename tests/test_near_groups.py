"""Near-copy groups against all pairs: families of many copies that are near each other, but mostly not near enough."""

import random

import numpy as np
import pytest

from riskloom.operators import dedup


def plain(texts, threshold=0.98):
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    order = sorted({top(i) for i in range(len(texts))})
    return [order.index(top(i)) for i in range(len(texts))], links


def altered(rng, text, times):
    out = list(text)
    for at in rng.sample(range(len(out)), times):
        out[at] = rng.choice("ABCDEFGHIJ0123456789")
    return "".join(out).lower()


def family(rng, size, often, length=900):
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
    return [altered(rng, base, rng.choice(often)) for _ in range(size)]


CASES = {
    "apart": lambda r: family(r, 120, [6, 8, 10]),
    "some near the centre": lambda r: family(r, 120, [0, 1, 2, 3, 5]),
    "nothing near the centre": lambda r: [altered(r, x, r.choice([0, 1, 1, 2])) for x in family(r, 8, [12]) for _ in range(12)],
    "short and long": lambda r: [*family(r, 40, [0, 1], 60), *family(r, 40, [0, 1, 2], 140), *family(r, 20, [10, 20, 30], 5000)],
    "two halves": lambda r: [altered(r, x, k) for x in family(r, 2, [9]) for k in [0, 1, 2, 3] * 12],
    "growing": lambda r: [x[: 860 + 4 * i] for x in family(r, 2, [3]) for i in range(40)],
}


@pytest.mark.parametrize("slice_rows", [512, 16])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(dedup, "SLICE", slice_rows)
    made = {name: make(random.Random(name)) for name, make in CASES.items()}
    rows = [(f"{name}/{i:04}", t, name) for name, texts in made.items() for i, t in enumerate(texts)]
    got = dict(dedup.near_groups(spark.createDataFrame(rows, "id string, text string, lang string").repartition(5), "id", "text", "lang").collect())
    for name, texts in made.items():
        want, links = plain(texts)
        assert links or name == "apart"
        mine = [got[f"{name}/{i:04}"] for i in range(len(texts))]
        assert [g - min(mine) for g in mine] == want


def test_copies_that_are_not_alike_are_not_compared_pair_by_pair(spark, monkeypatch):
    """400 copies, each altered at places of its own: 79,800 pairs of one family, of which few are tried."""
    seen = []
    whole = dedup._alike
    monkeypatch.setattr(dedup, "_alike", lambda held, pairs, t: seen.append(pairs.count()) or whole(held, pairs, t))
    texts = family(random.Random(5), 400, [7, 8])
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, lang string")
    assert dedup.near_groups(rows, "id", "text", "lang").select("group_id").distinct().count() == 400
    assert sum(seen) < 3 * 400


def test_sketches_tell_ranges():
    names = dedup.names_of("the quick brown fox jumps over the lazy dog" * 3)
    assert (dedup.sketch_of(names) == dedup.sketch_of(names)).all() and len(dedup.sketch_of(names)) == 8
    assert len(set(dedup.sketch_of(np.zeros(0, np.uint64)).tolist())) == 1
    other = dedup.sketch_of(names[1:])
    assert (other != dedup.sketch_of(names)).sum() == 1


def test_a_signature_is_that_of_plain_arithmetic_and_counts_only_if_asked(spark, monkeypatch):
    numbers = np.array([0, 1, 2, dedup.PRIME - 1, dedup.PRIME - 2, 12345, *range(7, 2_000_000_000, 9_999_991)])
    want = [min((int(h) * a + b) % dedup.PRIME for h in numbers) for a, b in dedup.permutations()]
    assert dedup.least_of(numbers).tolist() == want
    assert all(dedup.least_of(np.array([(-b * pow(a, -1, dedup.PRIME)) % dedup.PRIME]))[i] == 0 for i, (a, b) in enumerate(dedup.permutations()[:9]))
    rows = spark.createDataFrame([(1, "a text of some words"), (2, None)], "id long, t string")
    assert [r.n for r in dedup.signatures(rows, "id", "t", counted=False).orderBy("id").collect()] == [None, None]
    assert [r.n for r in dedup.signatures(rows, "id", "t").orderBy("id").collect()] == [12, 0]
