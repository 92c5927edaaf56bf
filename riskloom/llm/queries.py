"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, conversation_trie, cover_tree, main_text, ngram_join, packing, pieces, prefix_forest, quality, sharding, suffix_dedup, token_files, url_filters


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), 100)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(_read(spark, sf_dir, "documents"), path, 2048, with_ids=False).withColumnRenamed("id", "doc_id")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    out = pieces.round_trip(_read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return out.select("doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "path_score", "same")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.range_shards(_read(spark, sf_dir, "documents"), 8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(_read(spark, sf_dir, "embeddings"), 5, 50)


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_groups(_read(spark, sf_dir, "embeddings"), 0.93).withColumnRenamed("id", "vec_id")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_read(spark, sf_dir, "documents"), 75, 5).withColumnRenamed("id", "doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(quality.rated(docs, _read(spark, sf_dir, "labels")), quality.GRADES)
    return quality.score(docs.select("doc_id", "text"), model, keep_from=2).drop("text")


def list_changes(pages: DataFrame) -> DataFrame:
    """Dated list changes derived from the hosts of the pages: three lists, of which each takes up some hosts or their parent domains, no bare suffixes, and drops and readds part of them."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    names = hosts.select(F.explode(F.array("host", F.regexp_replace("host", r"^[^.]+\.", ""))).alias("domain")).where("domain like '%.%'").distinct()
    seeds = names.withColumn("list_name", F.explode(F.array(*map(F.lit, ("adult", "malware", "spam")))))
    seed = F.conv(F.substring(F.md5(F.concat_ws("|", "list_name", "domain")), 1, 8), 16, 10).cast("long")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    seeds = seeds.withColumn("seed", seed).where("seed % 3 = 0")
    start, lasts, pause = F.col("seed") % 200, 20 + F.col("seed") % 90, 10 + F.col("seed") % 50
    steps = F.array(
        F.struct(F.lit("add").alias("action"), day(start).alias("changed_at")),
        F.struct(F.lit("remove").alias("action"), day(start + lasts).alias("changed_at")),
        F.when(F.col("seed") % 2 == 0, F.struct(F.lit("add").alias("action"), day(start + lasts + pause).alias("changed_at"))),
    )
    return seeds.select("list_name", "domain", F.explode(steps).alias("step")).where("step is not null").select("list_name", "domain", "step.action", "step.changed_at")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetched_at"))
    return url_filters.temporal_filter(pages, list_changes(pages), "page_id").withColumnRenamed("id", "page_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"), 100, 5, 2000)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_nodes(_read(spark, sf_dir, "conversations"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark, "token-ids")
    token_files.write(_read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_packing": op2_packing,
    "op3_main_text": op3_main_text,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_sharding": op5_sharding,
    "op6_prefix_forest": op6_prefix_forest,
    "op7_ngram_join": op7_ngram_join,
    "op8_cover_tree": op8_cover_tree,
    "op9_quality": op9_quality,
    "op10_url_filters": op10_url_filters,
    "op11_collocations": op11_collocations,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_token_files": op13_token_files,
}

ORACLES = {
    "op1_suffix_dedup": r"""
WITH docs AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM docs)),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM strings) WHERE k > 1),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 100 THEN 0 ELSE 1 END AS new FROM repeated WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked) GROUP BY 1, 2),
gaps AS (SELECT doc_id, k, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y, b - a AS gone FROM runs),
ends AS (SELECT doc_id, max(b) AS b, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM gaps JOIN docs USING (doc_id) GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, coalesce(e.n_removed, 0)::BIGINT AS n_removed, coalesce(e.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h || substr(d.h, 2 * e.b + 1), d.h))) AS kept_sha256
FROM docs d LEFT JOIN ends e USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
    # the checksum byte by byte, with the table of the reversed polynomial 0xEDB88320
    "op5_sharding": r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
sized AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS digest, hex(encode(coalesce(text, ''))) AS h FROM documents),
placed AS (SELECT *, sum(size) OVER (ORDER BY digest, doc_id) - size AS p0, sum(size) OVER () AS total FROM sized),
dealt AS (SELECT *, least(7, p0 * 8 // total) AS s FROM placed),
groups AS (SELECT digest, min(p0) AS g_at, sum(size) AS bytes, min(s) < max(s) AS parted FROM dealt GROUP BY 1),
sharded AS (SELECT d.*, CASE WHEN parted AND bytes * 8 <= 0.02 * total THEN least(7, (g_at + bytes // 2) * 8 // total) ELSE s END AS shard FROM dealt d JOIN groups USING (digest))
SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, 2 * strlen(t), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1]))) AS text_crc32,
  'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY p0) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM sharded, steps""",
    "op7_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, found) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.found)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, (SELECT min(found) FROM reach r WHERE r.node = d.doc_id) AS component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id""",
    "op8_cover_tree": r"""
WITH RECURSIVE able AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(node, found) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.found),
roots AS (SELECT node, min(found) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept FROM embeddings e JOIN roots r ON r.node = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id""",
    "op10_url_filters": r"""
WITH caps AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS fetched_at,
    lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')) AS host
  FROM pages),
hosts AS (SELECT DISTINCT host FROM caps WHERE host <> ''),
names AS (SELECT host AS domain FROM hosts UNION SELECT regexp_replace(host, '^[^.]+\.', '') FROM hosts),
seeds AS (
  SELECT * FROM (SELECT l.list_name, n.domain, ('0x' || substr(md5(l.list_name || '|' || n.domain), 1, 8))::BIGINT AS seed
    FROM names n, (VALUES ('adult'), ('malware'), ('spam')) l(list_name) WHERE n.domain LIKE '%.%') WHERE seed % 3 = 0),
spans AS (
  SELECT list_name, domain, DATE '2024-01-01' + CAST(seed % 200 AS INTEGER) AS valid_from,
    DATE '2024-01-01' + CAST(seed % 200 + 20 + seed % 90 AS INTEGER) AS valid_to FROM seeds
  UNION ALL
  SELECT list_name, domain, DATE '2024-01-01' + CAST(seed % 200 + 20 + seed % 90 + 10 + seed % 50 AS INTEGER), NULL FROM seeds WHERE seed % 2 = 0),
hits AS (
  SELECT c.host, c.fetched_at, count(*) AS n_active, arg_min(s.list_name, (-length(s.domain), s.list_name)) AS first_list, arg_min(s.domain, (-length(s.domain), s.list_name)) AS matched_domain
  FROM (SELECT DISTINCT host, fetched_at FROM caps WHERE host <> '') c JOIN spans s
    ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain)) AND c.fetched_at >= s.valid_from AND (s.valid_to IS NULL OR c.fetched_at < s.valid_to)
  GROUP BY 1, 2)
SELECT c.page_id, c.url, CAST(c.fetched_at AS DATE) AS fetched_at, c.host, coalesce(h.n_active, 0) AS n_active, h.n_active IS NOT NULL AS blocked, h.first_list, h.matched_domain
FROM caps c LEFT JOIN hits h ON c.host = h.host AND c.fetched_at = h.fetched_at""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY 1),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) s(k)),
phrases AS (SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM places GROUP BY 1, 2, 3 HAVING count(*) >= 100),
inner_ones AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + k - 1], ' ') AS phrase, max(f) AS f
  FROM phrases, range(2, 5) s(k), range(1, 5) t(i) WHERE k < size AND i + k - 1 <= size GROUP BY 1, 2),
kept AS (SELECT p.lang, p.phrase, p.size, p.f AS a FROM phrases p LEFT JOIN inner_ones i ON i.lang = p.lang AND i.phrase = p.phrase WHERE p.size >= 2 AND (i.f IS NULL OR 100 * i.f < 100 * p.f)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, n, k, l.f AS l, r.f AS r, (1000 * c.a * n) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS w FROM kept) c JOIN totals t ON t.lang = c.lang
  JOIN phrases l ON l.lang = c.lang AND l.phrase = array_to_string(w[:k], ' ') JOIN phrases r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT lang, phrase, a, n, k, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    # the checksum of an id's digits as in op5
    "op12_conversation_trie": r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ordered AS (SELECT conv_id, {'role': role, 'text': text} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role)::VARCHAR || ':' || role || text)) AS i FROM turns),
ids AS (SELECT conv_id, hex(encode(conv_id::VARCHAR)) AS h FROM (SELECT DISTINCT conv_id FROM turns)),
convs AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1]))) % 6 AS h FROM ids, steps),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, o.i, o.t FROM convs c JOIN ordered o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.i <= c.h
  UNION ALL SELECT c.conv_id, 1, o.i, o.t FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.i > c.h),
paths AS (SELECT c.conv_id, coalesce(p.path, []) AS path FROM convs c LEFT JOIN (SELECT conv_id, list(t ORDER BY own, i) AS path FROM rebuilt GROUP BY 1) p USING (conv_id)),
begun AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM paths),
nodes AS (
  SELECT d, path[:d] AS key, min(conv_id) AS conv_id, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(any_value(path[d].text)) END AS own,
    sha256(coalesce(string_agg(CASE WHEN len(path) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends
  FROM begun GROUP BY 1, 2),
children AS (SELECT d - 1 AS d, key[:d - 1] AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
told AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.key = n.key),
sums AS (SELECT e AS d, key[:e] AS key, sum((n_children = 0)::BIGINT) AS leaves, sum(own) AS saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM told) GROUP BY 1, 2)
SELECT t.conv_id, t.d::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n AS n_convs, t.n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, t.ends AS ends_sha256
FROM told t JOIN sums s ON s.d = t.d AND s.key = t.key LEFT JOIN nodes p ON p.d = t.d - 1 AND p.key = t.key[:t.d - 1]""",
}
