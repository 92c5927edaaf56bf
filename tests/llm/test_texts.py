"""Text operators against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import encoder, main_text, packing, quality, sharding, suffix_dedup, url_filters

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_repeats(rows, length=100):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\1" * length
            seen.add(w)
        spans, p = [], 0
        while p < len(b):
            q = p
            while q < len(b) and mark[q]:
                q += 1
            if q > p:
                spans.append((p, q))
            p = q + 1
        out.append((i, len(b), spans, bytes(x for x, m in zip(b, mark, strict=True) if not m)))
    return out


def plain(result):
    return sorted((r.id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in result.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_repeats_are_the_plain_ones(spark, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(40, 260))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("xyz\n") for _ in range(90)) for _ in range(rng.randrange(0, 8)))) for i in range(60)]
    rows += [(100, "a" * 700), (101, "ab" * 300), (102, None), (103, ""), (104, "a" * 99), (105, "a" * 100), (106, rows[5][1]), (107, "abc" * 60 + "ab" * 80)]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    assert plain(suffix_dedup.remove_repeats(table)) == plain_repeats(rows)


@pytest.mark.parametrize(("q", "length"), [(3, 3), (3, 11), (4, 16), (5, 7)])
def test_pointers_tell_equal_strings(q, length):
    rng = random.Random(q * length)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(length, 60))).encode() for _ in range(30)] + [b"a" * 80, b"ab" * 40]
    data = b"".join(texts)
    room = np.concatenate([np.arange(len(t), 0, -1) for t in texts])[: len(data) - q + 1]
    seen = {}
    gram = np.array([seen.setdefault(data[i : i + q], len(seen) * 7919 % 1009) for i in range(len(data) - q + 1)], np.uint64)
    got = suffix_dedup.pointers(gram, room, q, length)
    named = {}
    for i in np.flatnonzero(room >= length).tolist():
        named.setdefault(data[i : i + length], set()).add(int(got[i]))
    assert all(len(x) == 1 for x in named.values())
    assert len(set().union(*named.values())) == len(named)


def test_repeats_in_a_bucket_with_many_contexts(spark, monkeypatch):
    rng = random.Random(7)
    said = "".join(rng.choice("abcdefgh") for _ in range(130))
    rows = [(i, "".join(rng.choice("stuvwxyz") for _ in range(200)) + said + "".join(rng.choice("stuvwxyz") for _ in range(200))) for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert plain(suffix_dedup.remove_repeats(table)) == plain_repeats(rows)


def test_repeats_of_a_dense_bucket_meet_those_of_slices_with_few_contexts(spark):
    rng = random.Random(11)
    noise = lambda: "".join(rng.choice("stuvwxyz") for _ in range(150))
    said = ["".join(rng.choice("abcdefgh") for _ in range(130)) for _ in range(40)]
    dense = [(i, noise() + said[i // 20] + noise()) for i in range(40 * 20)]
    few = [(1000 + i, noise() + s + noise()) for i, s in enumerate(said)]
    one, two = (spark.createDataFrame(rows, "doc_id long, text string").coalesce(1) for rows in (dense, few))
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(limit)
    spark.conf.set(limit, 20)  # a batch of documents holds one dense bucket; a batch of runs holds few of any bucket
    try:
        got = plain(suffix_dedup.remove_repeats(one.unionByName(two)))
    finally:
        spark.conf.set(limit, was)
    assert got == plain_repeats(dense + few)


def test_repeats_of_repeated_ids_and_no_rows(spark):
    text = "".join(map(str, range(200)))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text + "!")], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(rows)
    assert sorted((str(r.id), r.n_removed) for r in got.collect()) == [("1", 0), ("1", len(text)), ("None", len(text))]
    assert suffix_dedup.remove_repeats(rows.limit(0)).count() == 0


def test_a_very_long_text_is_taken_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdef") for _ in range(900))
    got = list(suffix_dedup._chunks([7], [text.encode()], 100))
    starts = [b + i for _, _, s, bases in got for j, b in enumerate(bases) for i in range((list(s) + [sum(len(d) for d, *_ in got)])[j + 1] - s[j] - 99)]
    assert sorted(starts) == list(range(801))


def test_pieces_and_places(spark, documents_sf001):
    rows = [(i, t) for i, t in enumerate(documents_sf001)] + [(1000, None), (1001, ""), (1002, "<|endoftext|> é\x00<|endoftext|>x"), (1003, "word " * 9000), (1004, " " * 2_000_000 + "x"), (1005, "a\tb \n c\u00a0d \u3000 e\r\nf\n\ng"), (1006, " lead"), (1007, "tail "), (1008, "汉字" * 3000)]
    got = packing.pack_documents(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, piece string"), PATH).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, text in rows:
        ids, at = model.encode(text or "", add_special_tokens=False).ids + [0], 0
        total += len(ids)
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids) == (k, at, ids[at : at + r.length])
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            assert r.length == 2048 or k == 0 and r.length < 2048
            at += r.length
        assert at == len(ids)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 1


def test_ids_are_the_tokenizer_s_over_whole_tables(documents_sf001):
    model = Tokenizer.from_file(PATH)
    texts = [t or "" for t in documents_sf001] + ["\n", "", " a", "a\nb", "a \n b", "\x1c a b", "it's 'tis don't 12 ab3", "x" * 100 + " " + "y" * 100, "<|endo ftext|>", "a <|endoftext|> b"]
    own = encoder.Encoder(PATH)
    own.ids(texts)
    got = [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)]
    assert got == [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]


def test_fullest_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(0, 60)
        sums = {0}
        for s in sizes:
            sums |= {x + s for x in sums}
        used = packing.fullest(Counter(sizes), room)
        assert sum(k * n for k, n in used.items()) == max(x for x in sums if x <= room)
        assert all(n <= sizes.count(k) for k, n in used.items())


def test_patterns_use_every_piece_once():
    counts = Counter(random.Random(6).randrange(1, 65) for _ in range(3000))
    used = Counter()
    for pattern, times in packing.patterns(counts, 64):
        assert sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            used[k] += n * times
    assert used == counts


def test_packing_no_rows(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("copies", [0, 400])
def test_shards_are_whole_equal_and_gapless(spark, copies):
    rng = random.Random(copies)
    rows = [(i, "x" * rng.randrange(0, 3000), "y") for i in range(600)] + [(1000 + i, "hot " * 300, "y") for i in range(copies)] + [(5000, None, "y"), (None, "n", "y"), (7, "again", "y"), (7, "again", "y")]
    got = sharding.range_shards(spark.createDataFrame(rows, "doc_id long, text string, shard string"), 8).collect()
    assert len(got) == len(rows)
    size, slots = Counter(), {}
    for r in got:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(size.values()) - min(size.values()) <= 2 * 3001
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)


def plain_shards(rows, shards=8, whole=0.02):
    digest = {t: hashlib.md5((t or "").encode()).hexdigest() for _, t in rows}
    total, at, out, groups = sum(len((t or "").encode()) + 1 for _, t in rows), 0, [], {}
    for i, t in sorted(rows, key=lambda r: (digest[r[1]], r[0])):
        size = len((t or "").encode()) + 1
        out.append([i, t, at, min(shards - 1, at * shards // total)])
        groups.setdefault(digest[t], []).append(out[-1])
        at += size
    for members in groups.values():
        size = sum(len((t or "").encode()) + 1 for _, t, _, _ in members)
        if size * shards <= whole * total:
            for m in members:
                m[3] = min(shards - 1, (members[0][2] + size // 2) * shards // total) if members[0][3] != members[-1][3] else m[3]
    slots = Counter()
    for m in out:
        m.append(slots[m[3]])
        slots[m[3]] += 1
    return {i: (shard, slot) for i, _, _, shard, slot in out}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_shards_are_the_plain_ones_and_keep_small_groups_whole(spark, seed):
    rng = random.Random(seed)
    texts = ["x" * rng.randrange(1, 200) for _ in range(40)] + [f"own {k} " * rng.randrange(1, 9) for k in range(1500)] + ["hot " * 40] * 900
    rows = [(i, rng.choice(texts)) for i in range(3000)]
    got = sharding.range_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    assert {r.id: (r.shard, r.slot) for r in got.collect()} == plain_shards(rows)


def test_shards_of_ids_of_other_kinds(spark):
    rows = [(f"id {i}" if i % 3 else None, "same" if i % 2 else f"t {i}") for i in range(900)]
    got = sharding.range_shards(spark.createDataFrame(rows, "doc_id string, text string"), 4).collect()
    assert Counter(r.id for r in got) == Counter(i for i, _ in rows)
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(4))


def test_shards_of_no_rows(spark):
    assert sharding.range_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


CHANGES = [("l", "a.com", "add", "2024-01-01"), ("l", "a.com", "remove", "2024-02-01"), ("l", "a.com", "add", "2024-03-01"), ("m", "x.a.com", "add", "2024-01-15"), ("m", "b.com", "remove", "2024-01-01"), ("m", None, "add", "2024-01-01"), ("l", " A.com. ", "add", "2024-03-05"), ("m", " . ", "add", "2024-01-01")]
CAPTURES = [
    (1, "http://x.a.com/p", "2024-01-01", 1, "a.com"),
    (2, "http://x.a.com:80/p", "2024-01-20", 2, "x.a.com"),
    (3, "https://u@A.com", "2024-02-01", 0, None),
    (4, "http://nota.com/", "2024-01-10", 0, None),
    (5, None, "2024-01-10", 0, None),
    (6, "http://a.com", None, 0, None),
    (7, "junk", "2024-01-10", 0, None),
    (8, "http://a.com", "2025-01-01", 1, "a.com"),
    (8, "http://a.com", "2025-01-01", 1, "a.com"),
    (9, "http://b.com", "2024-06-01", 0, None),
    (10, "http://a.com", "2023-12-31", 0, None),
]


def test_lists_hold_as_of_the_fetch(spark):
    changes = spark.createDataFrame(CHANGES, "list_name string, domain string, action string, at string").selectExpr("list_name", "domain", "action", "cast(at as date) changed_at")
    captures = spark.createDataFrame([(a, b, c, "z") for a, b, c, *_ in CAPTURES], "page_id long, url string, at string, domain string").selectExpr("page_id", "url", "cast(at as date) fetched_at", "domain")
    got = url_filters.temporal_filter(captures, changes, "page_id")
    assert sorted((r.id, r.n_active, r.blocked, r.matched_domain) for r in got.collect()) == sorted((i, n, n > 0, d) for i, _, _, n, d in CAPTURES)
    assert url_filters.temporal_filter(captures.limit(0), changes, "page_id").count() == 0
    assert url_filters.temporal_filter(captures, changes.limit(0), "page_id").where("blocked").count() == 0


def keep_all(_):
    return False


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("no tags at all", ["no tags at all"]),
        ("<body><header>H</header><div class='sidebar'>s</div><main><h2>T</h2><p>a<p>b &amp; c<div class='cookie-notice'>x</div><ul><li>one<li>two</ul></main><form><p>z</form>", ["T", "a", "b & c", "one", "two"]),
        ("<nav><a>m</a></nav><article><h1>T</h1><p><b>x<br><p>y&nbsp; z</article><aside>no</aside><footer>f", ["T", "x", "y z"]),
        ("<article><p>a<div id=comments><p>c</div><script>'</article>'</script><p>b</article>", ["a", "b"]),
        ("<div>say <i>it</i><!-- no > no --> now &lt;b&gt; &#233; 1 < 2</div>", ["say it now <b> é 1 < 2"]),
        ("<article><p>x<style>p{}", ["x"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<body><div class='post share-price'><p>Shares of the firm rose</p></div><div class='share-buttons top'>x</div><div class='ad_box-2'>y</div><div class='cookie-law-xy'>z</div><div id='relatedPosts'>r</div>", ["Shares of the firm rose"]),
        ("<p><a href=x>All of it is a link</a></p><ul><li><a href=y>menu</a><li>entry</ul>", ["All of it is a link", "entry"]),
        ("<article class='comment'><p>c</article><div class='post'><p>t</div><div id='post-comments'>c</div>", ["t"]),
    ],
)
def test_main_text(page, want):
    assert main_text.blocks(page, keep_all) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<main><h1>T</h1><p>a long text of the page</p></main><article><p>teaser</article>", ["T", "a long text of the page"]),
        ("<main><h1>T</h1><article><p>a</article><p>z</main>", ["T", "a", "z"]),
        # an article is the page's main text, however long what stands beside it
        ("<div><p>a long text of the page</div><article><p>short</article>", ["short"]),
        ("<article><p>one</article><article><p>two</article><div><p>a side text, much longer than both</div>", ["one", "two"]),
        ("<div><p>a text</div><article><nav>n</nav></article>", ["a text"]),
    ],
)
def test_main_text_is_where_the_article_is(page, want):
    assert main_text.blocks(page, keep_all) == want


def test_templates_of_a_site_go(spark):
    page = lambda i: f"<body><div><p>About us and our site</p></div><div><p>Story {i} of many</p></div></body>"
    rows = [(i, "http://s.com/" + str(i), page(i), "t") for i in range(8)] + [(20, "http://other.com", page(0), "t"), (21, None, page(0), "t"), (22, "http://s.com/n", None, "t"), (0, "http://s.com/0", page(0), "t")]
    got = sorted((r.id, r.text, r.n_chars) for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    whole = lambda i: f"About us and our site\nStory {i} of many"
    want = [(i, f"Story {i} of many") for i in [0, *range(8)]] + [(20, whole(0)), (21, whole(0)), (22, "")]
    assert got == [(i, t, len(t)) for i, t in want]
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "page",
    ["<a " * 40_000, '<a href="' * 40_000, "<div>" * 20_000 + "</span></p></td>" * 20_000, "<div>" * 20_000 + "<td></td>" * 20_000, "<nav>" + "<b>" * 20_000 + "<div></div>" * 20_000, "<!--" * 40_000, "<p>x" * 20_000, "<li>" * 20_000, "&amp" * 40_000, "<script>" * 20_000],
)
def test_odd_pages_take_no_more_than_their_length(page):
    began = time.process_time()
    main_text.blocks(page, keep_all)
    assert time.process_time() - began < 10


def test_text_after_the_last_tag_stays():
    assert main_text.blocks("<p>a</p>b < c <d", keep_all) == ["a", "b < c <d"]
    assert main_text.blocks("<p>a</p>c<!-- b", keep_all) == ["a", "c"]
    assert main_text.blocks("<p>a</p>c<!-- b <p>d</p> e", keep_all) == ["a", "c"]
    assert main_text.blocks("<p>a</p>c<!-- b --><p>d</p>&lt; e <? f", keep_all) == ["a", "c", "d", "< e"]


def test_templates_are_those_of_a_plain_recount(spark):
    rng = random.Random(12)
    shared = {h: [f"<div><p>site {h} says {k}</p><ul><li>one {k}</li><li>two</li></ul></div>" for k in range(4)] for h in "ab"}
    pages = []
    for i in range(40):
        h = "ab"[i % 2]
        blocks = [x for k, x in enumerate(shared[h]) if rng.random() < (0.95, 0.7, 0.3, 0.1)[k]] + [f"<div><p>own {i} {k}</p><p>more {i}</p></div>" for k in range(2)]
        rng.shuffle(blocks)
        pages.append((h, blocks))
    count, size = Counter((h, b) for h, bs in pages for b in set(bs)), Counter(h for h, _ in pages)
    count.update((h, "<li>two</li>") for h, bs in pages if any("<li>two</li>" in b for b in bs))
    gone = {x for x, n in count.items() if n >= main_text.PAGES and n > main_text.SHARE * size[x[0]]}
    words = lambda b: [x for x in re.sub("<[^>]*>", "\n", b).split("\n") if x]
    want = {i: "\n".join(w for b in bs if (h, b) not in gone for w in words(b.replace("<li>two</li>", "") if (h, "<li>two</li>") in gone else b)) for i, (h, bs) in enumerate(pages)}
    rows = spark.createDataFrame([(i, f"http://{h}.com/{i}", "<body>" + "".join(bs) + "</body>") for i, (h, bs) in enumerate(pages)], "page_id long, url string, html string")
    assert len(gone) >= 4
    assert {r.id: r.text for r in main_text.extract(rows).collect()} == want


def test_copies_of_a_page_are_no_template(spark):
    page = lambda i: f"<body><div><p>About us and our site</p></div><article><p>Story {i} of many</p></article></body>"
    rows = [(i, f"http://s.com/{i}", page(0)) for i in range(8)] + [(10 + i, f"http://s.com/n{i}", page(i)) for i in range(1, 5)]
    got = {r.id: r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "Story 0 of many" for i in range(8)} | {10 + i: f"Story {i} of many" for i in range(1, 5)}


@pytest.fixture(scope="module")
def rated(spark, sf001):
    sf = sf001.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return quality.rated(docs, labels).toPandas()


def test_held_out_grades(spark, rated):
    test = rated["doc_id"] % 4 == 0
    model = quality.fit(spark.createDataFrame(rated[~test]), quality.GRADES)
    assert model.thresholds[0] < model.thresholds[1]
    got = quality.score(spark.createDataFrame(rated[test]), model, keep_from=2).toPandas()
    kept = got.groupby("grade")["kept"].mean()
    assert kept[2] >= 0.97
    assert kept[0] <= 0.3
    assert kept[1] <= 0.35
    means = got.groupby("grade")["expected_grade"].mean()
    assert means[0] < means[1] < means[2]


def test_the_fit_is_an_optimum_of_the_plain_likelihood():
    rng = np.random.default_rng(4)
    n, bits, penalty = 200, 4, 1e-2
    rows = [[] for _ in range(n)]
    for f in range(16):
        for i in rng.choice(n, 14, replace=False):
            rows[i].append(f)
    truth = rng.standard_normal(16)
    grade = np.array([int(sum(truth[r]) + rng.logistic() > -0.5) + int(sum(truth[r]) + rng.logistic() > 1.0) for r in rows])
    model = quality._descend(grade, np.array([f for r in rows for f in r]), np.array([len(r) for r in rows]), 3, bits, penalty, 500)

    def plain(weights, cuts):
        total = 0.0
        for r, g in zip(rows, grade.tolist(), strict=True):
            z = sum(weights[f] for f in r)
            at_least = [1.0, *(1 / (1 + math.exp(c - z)) for c in cuts), 0.0]
            total -= math.log(at_least[g] - at_least[g + 1])
        return total / n + penalty / 2 * sum(w * w for w in weights)

    weights, cuts = model.weights.astype(float).tolist(), model.thresholds.tolist()
    assert cuts[0] < cuts[1]
    for k in range(18):
        up, down = [*weights, *cuts], [*weights, *cuts]
        up[k] += 1e-4
        down[k] -= 1e-4
        assert abs(plain(up[:16], up[16:]) - plain(down[:16], down[16:])) / 2e-4 < 1e-4
    assert plain(weights, cuts) < plain([0.0] * 16, cuts)


def test_grades_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "good words here", 2), (2, "bad", 0), (3, None, 1), (4, "x", None), (5, "", 2), (5, "", 2)], "doc_id long, text string, grade int")
    model = quality.fit(rows, 3)
    got = quality.score(rows.withColumnRenamed("grade", "kept"), model, 2)
    assert got.count() == 6
    assert {c for c, _ in got.dtypes} == {"doc_id", "text", "expected_grade", "tail_probability", "kept"}
    flat = quality.fit(rows.limit(0), 3)
    assert quality.score(rows, flat, 2).select("tail_probability").distinct().count() == 1
    assert quality.score(rows.limit(0), flat, 2).count() == 0


def test_digest_is_of_what_is_kept(spark):
    text = "".join(map(str, range(300)))
    row = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text), (2, "new " + text)], "doc_id long, text string")).where("id = 2").first()
    assert hashlib.sha256(bytes(row.kept)).hexdigest() == hashlib.sha256(b"new ").hexdigest()
