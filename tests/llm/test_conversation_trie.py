"""The conversation trie against a plain one."""

import hashlib
import random
import zlib

import duckdb
import pytest

from riskloom.llm import conversation_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string"


def plain(rows):
    """rows: (conv, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, name, role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        turns = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        below = children.get(key, [])
        leaves[key] = sum(leaves[x] for x in below) or 1
        saved[key] = sum(saved[x] for x in below) + (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
    digest = {k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest() for k in members}
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], digest[k]) for k, m in members.items()), key=str)


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(parts)


def nodes(frame):
    assert frame.columns == COLUMNS
    return sorted(map(tuple, frame.collect()), key=str)


def made(seed):
    """Branching talks with many copies, chains of common turns, and some long ones."""
    rng, rows = random.Random(seed), []
    for c in range(-60, 240):
        if rng.random() < 0.1:
            continue
        kind = rng.random()
        if kind < 0.3:
            talk = ["hot", "hotter", "copied"]
        elif kind < 0.6:
            talk = ["hot", *("chain" for _ in range(8)), *(rng.choice("ab") for _ in range(rng.randrange(4)))]
        else:
            talk = [rng.choice(["hot", "é汉", "", "x"]) for _ in range(rng.randrange(1, 7))]
        rows += [(c, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(talk)]
    return rows + [(1000, i, "u", f"long {i}") for i in range(150)]


@pytest.mark.parametrize(("seed", "most", "held"), [(0, 4, 1), (1, 60, 100), (2, 2048, 4 << 20)])
def test_nodes_are_the_plain_ones(spark, monkeypatch, seed, most, held):
    monkeypatch.setattr(conversation_trie, "HELD", held)
    rows = made(seed)
    assert nodes(conversation_trie.prefix_nodes(table(spark, rows), most)) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (1, 0, "a", None), (2, 5, None, "b"), (2, 5, "b", None), (3, 1, "12", "x"), (4, 1, "1", "2x"), (100, None, "", ""), (199, 3, "z", "z"), (-1, 0, "z", "z"), (None, 0, "lost", "lost"), (2**62, 1, "a", "t" * 100_000)]
    for most in (3, 2048):
        assert nodes(conversation_trie.prefix_nodes(table(spark, rows), most)) == plain(rows)


def test_no_rows(spark):
    for rows in ([], [(None, 1, "a", "b")]):
        assert nodes(conversation_trie.prefix_nodes(table(spark, rows))) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(x for x in range(101, 200) if zlib.crc32(str(x).encode()) % 6 > 0)
    (root,) = nodes(conversation_trie.prefix_nodes(table(spark, [(c, 0, "a", "b")]), 1))
    assert root == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())


def test_the_query_is_the_plain_one_and_its_sql(spark, sf001):
    rows = spark.read.parquet(f"{sf001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = nodes(queries.op12_conversation_trie(spark, sf001))
    assert got == plain([tuple(r) for r in rows])
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf001}/conversations.parquet'")
    said = duckdb.sql(queries.ORACLES["op12_conversation_trie"])
    assert sorted(map(tuple, said.select(", ".join(COLUMNS)).fetchall()), key=str) == got
