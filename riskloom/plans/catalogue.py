"""Query catalogue: one callable per operator, with its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed, text as tx, url as ur
from ..operators import boosting, dedup, embedding, explain, html_features, metrics, models, reports, splits, umap
from ..operators.stages import shared_dir, stage
from ..sources import page_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# ---- URLs ----

# Addresses derived from each page's own, so that all rules have work.
_VARIANTS = {
    "own": ("url", "url"),
    "address": ("concat('http://', page_id % 256, '.168.0.', page_id % 200, '/login')",) * 2,
    "tld": ("concat('http://shop', page_id, '.', element_at(array('tk', 'xyz', 'com', 'zip'), cast(page_id % 4 + 1 as int)), '/')", "concat('http://shop', page_id, '.', ['tk', 'xyz', 'com', 'zip'][page_id % 4 + 1], '/')"),
    "user": ("concat(replace(url, '://', '://user@'), '@')",) * 2,
    "port": ("concat('example.com:', page_id * 97 % 70000, '/x')",) * 2,
    "deep": ("concat('https://', repeat('a.', cast(page_id % 7 as int)), 'ex', repeat('-a', cast(page_id % 6 as int)), '.com', repeat('/p', cast(page_id % 9 as int)))",) * 2,
    "long": ("concat('https://xn--x', page_id, '.org/', repeat('q', cast(page_id % 260 as int)))",) * 2,
    "coded": ("concat('http://a%', page_id * 1000, 'b.net?x=/', page_id)",) * 2,
}
_STACKED = "\nUNION ALL\n".join(f"SELECT page_id, '{k}' AS variant, {sql} AS url FROM pages" for k, (_, sql) in _VARIANTS.items())


def url_variants(pages: DataFrame) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(k).alias("variant"), F.expr(e).alias("url")) for k, (e, _) in _VARIANTS.items()))
    return pages.select("page_id", F.explode(kinds).alias("v")).select("page_id", "v.*")


_RISK_SQL = r"""
parsed AS (
  SELECT *, regexp_replace(regexp_extract(CASE WHEN contains(url, '://') THEN url ELSE 'http://' || url END, '^[^/?#]*://([^/?#]*)', 1), '^.*@', '') AS server,
    regexp_extract(CASE WHEN contains(url, '://') THEN url ELSE 'http://' || url END, '^[^/?#]*://[^/?#]*([^?#]*)', 1) AS path FROM addresses),
hosts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(server, '^([^:]*)', 1)), '^\.+', ''), '\.+$', '') AS host, regexp_extract(server, '^[^:]*:?(.*)$', 1) AS port_text FROM parsed),
names AS (SELECT *, string_split(host, '.') AS labels, TRY_CAST(port_text AS INTEGER) AS port FROM hosts),
named AS (
  SELECT *, labels[-1] AS tld, greatest(len(labels) - 2, 0) AS below, CASE WHEN len(labels) >= 2 THEN labels[-2] ELSE labels[1] END AS name,
    (port_text <> '' AND (port IS NULL OR port > 65535)) OR host = '' AS broken FROM names),
counted AS (
  SELECT *, length(name) - length(replace(name, '-', '')) AS hyphens, length(regexp_replace(name, '[^0-9]', '', 'g')) AS digits, length(path) - length(replace(path, '/', '')) AS depth FROM named),
fired AS (
  SELECT page_id, variant, rule, label, impact FROM counted, LATERAL (VALUES
    (0, regexp_matches(host, '^\d{1,3}(\.\d{1,3}){3}$'), 'IP address as hostname', 0.55),
    (1, tld IN (TLDS), 'High-risk TLD (.' || tld || ')', 0.30),
    (2, contains(host, 'xn--'), 'Punycode / IDN homograph domain', 0.40),
    (3, contains(url, '@'), '@ symbol in URL', 0.45),
    (4, below >= 4, below || ' subdomain levels', 0.35),
    (5, below = 3, '3 subdomain levels', 0.15),
    (6, hyphens >= 4, hyphens || ' hyphens in domain', 0.25),
    (7, hyphens = 3, '3 hyphens in domain', 0.10),
    (8, port > 0 AND port NOT IN (80, 443, 8080, 8443), 'Non-standard port (' || port || ')', 0.20),
    (9, length(url) > 200, 'Very long URL (' || length(url) || ' chars)', 0.20),
    (10, length(url) BETWEEN 121 AND 200, 'Long URL (' || length(url) || ' chars)', 0.08),
    (11, contains(host, '%'), 'URL-encoded characters in hostname', 0.35),
    (12, digits >= 5, 'Many digits in domain (' || digits || ')', 0.12),
    (13, depth >= 6, 'Deep URL path (/' || depth || ' levels)', 0.10)) r(rule, fires, label, impact)
  WHERE fires AND NOT broken),
summed AS (SELECT page_id, variant, round(least(sum(impact::DOUBLE), 1.0), 4) AS score, string_agg(label, '; ' ORDER BY impact DESC, rule) AS signals FROM fired GROUP BY 1, 2)
""".replace("TLDS", ", ".join(f"'{x}'" for x in fixed.SUSPECT_TLDS))


@query(
    f"WITH addresses AS ({_STACKED}),\n{_RISK_SQL}\n"
    "SELECT a.page_id, a.variant, a.url, coalesce(s.score, 0.0) AS score, coalesce(s.signals, '') AS signals FROM addresses a LEFT JOIN summed s ON a.page_id = s.page_id AND a.variant = s.variant"
)
def url_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = url_variants(read(spark, sf_dir, "pages")).withColumn("r", ur.risk(F.col("url")))
    return rated.select("page_id", "variant", "url", F.col("r.score").alias("score"), F.array_join("r.signals.label", "; ").alias("signals"))


@query(
    f"""WITH addresses AS (SELECT page_id, 'own' AS variant, url FROM pages), {_RISK_SQL},
letters AS (SELECT page_id, ch, count(*) AS n FROM (SELECT page_id, unnest(string_split(html, '')) AS ch FROM pages WHERE html <> '') GROUP BY 1, 2),
bits AS (SELECT page_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM letters GROUP BY 1)
SELECT p.page_id, p.url, length(coalesce(p.html, '')) AS raw_len, round(coalesce(b.e, 0.0), 6) AS shannon_entropy, coalesce(s.score, 0.0) AS url_score,
  CASE WHEN coalesce(s.score, 0.0) >= 0.5 THEN 'phishing' WHEN coalesce(s.score, 0.0) >= 0.25 THEN 'suspicious' ELSE 'safe' END AS verdict
FROM pages p LEFT JOIN bits b ON p.page_id = b.page_id LEFT JOIN summed s ON p.page_id = s.page_id"""
)
def page_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    score = ur.risk(F.col("url"))["score"]
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", F.length(html).alias("raw_len"), F.round(html_features.entropy_of(html), 6).alias("shannon_entropy"), score.alias("url_score"), tx.verdict(score).alias("verdict"))


# hrefs in double quotes, in single ones and bare, by page
_QUOTED = """CASE WHEN page_id % 3 = 0 THEN html WHEN page_id % 3 = 1 THEN regexp_replace(html, 'href="([^"]*)"', concat('href=', chr(39), '{1}', chr(39)){g}) ELSE regexp_replace(html, 'href="([^"]*)"', 'href={1}'{g}) END"""


def quoted(pages: DataFrame) -> DataFrame:
    return pages.withColumn("html", F.expr(_QUOTED.replace("{1}", "$1").replace("{g}", "")))


_HREFS = "quoted AS (SELECT page_id, " + _QUOTED.replace("{1}", "\\1").replace("{g}", ", 'g'") + r""" AS html FROM pages), hrefs AS (
  SELECT page_id, h.href FROM quoted, LATERAL (SELECT unnest(list_transform(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?(</(?:script|style)\s*>)', '\1\2', 'g'), '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda x: trim(x, '"' || chr(39)))) AS href) h),
made AS (
  SELECT page_id, href, v.variant, v.target FROM hrefs, LATERAL (VALUES ('own', href), ('empty', ' '), ('script', 'javascript:' || href), ('data', 'data:' || href), ('mail', 'mailto:a@' || href), ('anchor', '#' || href),
    ('out', 'https://x.org' || href), ('login', 'http://x.org' || href || '/LogIn'), ('upper', 'HTTP://x.org' || href)) v(variant, target))"""


def href_variants(pages: DataFrame) -> DataFrame:
    h = F.col("href")
    made = {"own": h, "empty": F.lit(" "), "script": F.concat(F.lit("javascript:"), h), "data": F.concat(F.lit("data:"), h), "mail": F.concat(F.lit("mailto:a@"), h), "anchor": F.concat(F.lit("#"), h)}
    made |= {"out": F.concat(F.lit("https://x.org"), h), "login": F.concat(F.lit("http://x.org"), h, F.lit("/LogIn")), "upper": F.concat(F.lit("HTTP://x.org"), h)}
    rows = quoted(pages).select("page_id", F.explode(html_features.hrefs(F.col("html"))).alias("href"))
    return rows.select("page_id", "href", F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), c.alias("target")) for k, c in made.items()))).alias("v")).select("page_id", "href", "v.*")


@query(
    f"""WITH {_HREFS}
SELECT page_id, href, variant, CASE WHEN trim(target) = '' THEN 'URL_EMPTY' WHEN starts_with(target, 'javascript') THEN 'URL_JS' WHEN starts_with(target, 'data:') THEN 'URL_DATA' WHEN starts_with(target, 'mailto:') THEN 'URL_MAIL'
  WHEN starts_with(target, '#') THEN 'URL_ANCHOR' WHEN NOT (starts_with(target, 'http://') OR starts_with(target, 'https://')) THEN 'URL_INT' WHEN regexp_matches(target, '(?i){'|'.join(fixed.SENSITIVE)}') THEN 'URL_EXT_SENSITIVE' ELSE 'URL_EXT' END AS token
FROM made"""
)
def neutralize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return href_variants(read(spark, sf_dir, "pages")).select("page_id", "href", "variant", ur.neutral(F.col("target")).alias("token"))


@query(
    rf"""WITH addresses AS ({_STACKED}), norm AS (SELECT page_id, variant, CASE WHEN trim(url) = '' THEN NULL WHEN starts_with(trim(url), 'http://') OR starts_with(trim(url), 'https://') THEN trim(url) ELSE 'https://' || trim(url) END AS normalized FROM addresses)
SELECT page_id, variant, normalized, regexp_replace(normalized, '/+$', '') <> regexp_replace(normalized || '/', '/+$', '') AS slash_only, regexp_replace(normalized, '/+$', '') <> regexp_replace(replace(normalized, '.com', '.org'), '/+$', '') AS redirected,
  regexp_extract(normalized, '^[^/?#]*://([^/?#]*)', 1) <> regexp_extract(replace(normalized, '.com', '.org'), '^[^/?#]*://([^/?#]*)', 1) AS domain_changed,
  regexp_extract(normalized, '^[^/?#]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(normalized, '^[^?#]*(\?[^#]*)', 1) AS query FROM norm"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_variants(read(spark, sf_dir, "pages")).withColumn("normalized", ur.normalized(F.col("url")))
    n, moved = F.col("normalized"), F.replace("normalized", F.lit(".com"), F.lit(".org"))
    p = ur.parts(n)
    return rows.select("page_id", "variant", "normalized", ur.redirected(n, F.concat(n, F.lit("/"))).alias("slash_only"), ur.redirected(n, moved).alias("redirected"), ur.domain_changed(n, moved).alias("domain_changed"), p["path"].alias("path"), p["query"].alias("query"))


# ---- pages ----


@query("SELECT page_id, length(html) AS raw_len FROM pages")
def html_raw_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.length("html").alias("raw_len"))


@query(
    """WITH letters AS (SELECT page_id, ch, count(*) AS n FROM (SELECT page_id, unnest(string_split(html, '')) AS ch FROM pages WHERE html <> '') GROUP BY 1, 2)
SELECT p.page_id, round(coalesce(e, 0.0), 6) AS shannon_entropy FROM pages p LEFT JOIN (SELECT page_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM letters GROUP BY 1) l ON p.page_id = l.page_id"""
)
def html_shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_features.entropy(read(spark, sf_dir, "pages"), "page_id", "html").select("page_id", F.round("shannon_entropy", 6).alias("shannon_entropy"))


@query(
    r"WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?(</(?:script|style)\s*>)', '\1\2', 'g') AS b FROM pages) SELECT page_id, "
    + ", ".join(f"len(regexp_extract_all(b, '(?i)<{t}[\\s/>]')) AS count_tag__{t}" for t in fixed.COUNTED_TAGS)
    + " FROM bare"
)
def html_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_features.tag_counts(read(spark, sf_dir, "pages"), "page_id", "html")


@query(
    f"""WITH {_HREFS}, kept AS (SELECT page_id, trim(href) AS h FROM hrefs WHERE trim(href) <> '' AND NOT starts_with(trim(href), '#') AND NOT starts_with(trim(href), 'javascript'))
SELECT p.page_id, coalesce(e, 0)::BIGINT AS count_external_links, coalesce(i, 0)::BIGINT AS count_internal_links FROM pages p LEFT JOIN (
  SELECT page_id, count_if(starts_with(h, 'http://') OR starts_with(h, 'https://')) AS e, count_if(NOT (starts_with(h, 'http://') OR starts_with(h, 'https://'))) AS i FROM kept GROUP BY 1) k ON p.page_id = k.page_id"""
)
def html_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_features.link_counts(quoted(read(spark, sf_dir, "pages")), "page_id", "html")


@query()
def html_dom_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_features.features(read(spark, sf_dir, "pages"), "page_id", "html")


@query()
def text_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_features.text_channels(read(spark, sf_dir, "pages"), "page_id", "html")


_ASCII = "regexp_replace(text, '[^ -~]+', ' '{g})"
_TALK = "replace(replace(replace({t}, ' the ', ' PayPal '), ' and ', ' sign-in '), ' of ', ' verify your account ')"


@query(
    "WITH talk AS (SELECT doc_id, " + _TALK.format(t=_ASCII.format(g=", 'g'")) + f""" AS t FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i){tx.BRAND_PATTERN}', '[BRAND]', 'g'), '(?i){tx.ACTION_PATTERN}', '[ACTION]', 'g'), '\\s+', ' ', 'g')) AS scrubbed FROM talk"""
)
def scrub_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = F.expr(_TALK.format(t=_ASCII.format(g="")))
    return read(spark, sf_dir, "documents").select("doc_id", tx.clean(tx.scrubbed(talk)).alias("scrubbed"))


@query(
    """SELECT page_id, page_id * 37 % 101 / 100.0::DOUBLE AS score, CASE WHEN page_id * 37 % 101 >= 50 THEN 'phishing' WHEN page_id * 37 % 101 >= 25 THEN 'suspicious' ELSE 'safe' END AS verdict, (page_id * 37 % 101)::DOUBLE AS percent FROM pages"""
)
def verdict_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("page_id") * 37 % 101 / F.lit(100.0)
    return read(spark, sf_dir, "pages").select("page_id", score.alias("score"), tx.verdict(score).alias("verdict"), tx.percent(score).alias("percent"))


def _told(page_id: Column, html: Column) -> Column:
    """Pages to each of which one of the phrases, in turn, is added; every fourth has none."""
    said = F.array(*map(F.lit, [*fixed.CHALLENGES, *(x.upper() for x in fixed.PARKED)]))
    return F.when(page_id % 4 == 0, html).otherwise(F.concat(html, F.get(said, (page_id % F.size(said)).cast("int"))))


_SAID = ", ".join("'" + x.replace("'", "''") + "'" for x in [*fixed.CHALLENGES, *(x.upper() for x in fixed.PARKED)])


@query(
    f"""WITH told AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN html ELSE html || ([{_SAID}])[page_id % 12 + 1] END AS t FROM pages)
SELECT page_id, array_to_string(list_filter([{', '.join("'" + x + "'" for x in fixed.CHALLENGES)}], lambda s: contains(t, s)), '; ') AS challenges, array_to_string(list_filter([{', '.join("'" + x + "'" for x in fixed.PARKED)}], lambda s: contains(lower(t), lower(s))), '; ') AS parked FROM told"""
)
def challenge_parked(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = read(spark, sf_dir, "pages").select("page_id", _told(F.col("page_id"), F.col("html")).alias("html"))
    return told.select("page_id", F.array_join(tx.challenges(F.col("html")), "; ").alias("challenges"), F.array_join(tx.parked(F.col("html")), "; ").alias("parked"))


# every fourth title gets references and white space
_TITLED = "CASE WHEN page_id % 4 = 0 THEN replace(html, '<title>', '<TITLE lang=x>  &lt;b&gt; &amp;lt; ') ELSE html END"


@query(
    rf"""WITH told AS (SELECT page_id, regexp_extract(substr({_TITLED}, 1, 20000), '(?is)<title(?:\s[^>]*)?>(.*?)</title', 1) AS t FROM pages)
SELECT page_id, substr(trim(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')), 1, 120) AS title FROM told"""
)
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html_features.title_of(F.expr(_TITLED)).alias("title"))


# where a page's address leads: to itself, to itself with slashes, to a subdomain or to another site
_LANDED = "CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1 THEN concat(url, '//') WHEN page_id % 4 = 2 THEN replace(url, '://', '://m.') ELSE concat('http://shop', page_id, '.tk/') END"


def landed(pages: DataFrame) -> DataFrame:
    return pages.withColumn("final_url", F.expr(_LANDED))


@query(
    f"""WITH landed AS (SELECT *, {_LANDED} AS final_url, coalesce(html, '') AS h FROM pages)
SELECT page_id, regexp_replace(url, '/+$', '') <> regexp_replace(final_url, '/+$', '') AS redirected, regexp_extract(url, '^[^/?#]*://([^/?#]*)', 1) <> regexp_extract(final_url, '^[^/?#]*://([^/?#]*)', 1) AS domain_changed,
  list_filter([{', '.join("'" + x + "'" for x in fixed.CHALLENGES)}], lambda s: contains(h, s)) AS challenges,
  list_filter([{', '.join("'" + x + "'" for x in fixed.PARKED)}], lambda s: contains(lower(h), lower(s))) AS parked,
  len(string_split_regex(h, '\\r\\n|\\r|\\n'))::INTEGER AS n_lines, array_to_string(string_split_regex(h, '\\r\\n|\\r|\\n')[:50], chr(10)) AS head FROM landed"""
)
def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.diagnose(landed(read(spark, sf_dir, "pages")), "page_id", "url", "html", "final_url")


# ---- copies, splits ----


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5, min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS group_id FROM documents")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(read(spark, sf_dir, "documents"), "doc_id", "text")


_SHINGLED = r"WITH packed AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS t FROM documents), runs AS (SELECT DISTINCT doc_id, substr(t, i, 5) AS s FROM (SELECT doc_id, t, unnest(range(1, length(t) - 3)) AS i FROM packed))"


@query(_SHINGLED + " SELECT d.doc_id, count(s) AS n_shingles, min(s) AS first_shingle FROM documents d LEFT JOIN runs r ON d.doc_id = r.doc_id GROUP BY 1")
def shingle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = dedup.summary_of_runs(tx.packed(F.col("text")))
    return read(spark, sf_dir, "documents").select("doc_id", told.alias("r")).select("doc_id", F.col("r.n").alias("n_shingles"), F.col("r.first").alias("first_shingle"))


# the number of a run, a polynomial of its characters modulo the prime
_POLYNOMIAL = "0::BIGINT"
for _i in range(1, dedup.SHINGLE + 1):
    _POLYNOMIAL = f"(({_POLYNOMIAL}) * {dedup.BASE} + unicode(substr(s, {_i}, 1))) % {dedup.PRIME}"


@query(
    _SHINGLED
    + f""", hashed AS (SELECT DISTINCT doc_id, {_POLYNOMIAL} AS h FROM runs),
perms AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(dedup.permutations()))}) p(perm, a, b))
SELECT d.doc_id, p.perm, coalesce(min((h * a + b) % {dedup.PRIME}), {dedup.PRIME}) AS least FROM documents d, perms p LEFT JOIN hashed h ON d.doc_id = h.doc_id GROUP BY 1, 2"""
)
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = dedup.signatures(read(spark, sf_dir, "documents"), "doc_id", "text", counted=False)
    return signed.select("doc_id", F.posexplode("signature").alias("perm", "least"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts, taken as pages: those of low quality stand in for the positive class."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg((1 - F.min("quality")).alias("label"))
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("html")).join(labels, "doc_id")


@query(
    r"""WITH RECURSIVE keyed AS (SELECT doc_id, lang, md5(coalesce(text, '')) AS md5, lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS t FROM documents),
kinds AS (SELECT md5, lang, min(doc_id) AS rep, any_value(t) AS t FROM keyed GROUP BY 1, 2),
sets AS (SELECT rep, lang, list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) AS s FROM kinds),
pairs AS (SELECT a.rep AS a, b.rep AS b, len(a.s) AS n, len(b.s) AS m, len(list_intersect(a.s, b.s)) AS shared FROM sets a JOIN sets b
  ON a.lang = b.lang AND a.rep > b.rep AND least(len(a.s), len(b.s)) >= 0.98 * greatest(len(a.s), len(b.s))),
links AS (SELECT a, b FROM pairs WHERE shared >= 0.98 * (n + m - shared) UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY md5) FROM keyed UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY md5, lang) FROM keyed),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, found) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.found),
roots AS (SELECT node, min(found) AS root FROM reach GROUP BY 1)
SELECT node AS doc_id, dense_rank() OVER (ORDER BY root) - 1 AS group_id FROM roots"""
)
def near_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_groups(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")


@query(
    """WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS group_id FROM documents),
o AS (SELECT group_id, row_number() OVER (ORDER BY md5(group_id || '|42') || '|' || group_id) - 1 AS n, count(*) OVER () AS total FROM (SELECT DISTINCT group_id FROM g)),
s AS (SELECT *, -(-total * 6 // 10) AS x, (total * 6 + 9) // 10 AS rest FROM o)
SELECT g.doc_id, g.group_id, CASE WHEN n < total - rest THEN 'train' WHEN n < total - (rest * 5 + 9) // 10 THEN 'val' ELSE 'test' END AS split FROM g JOIN s USING (group_id)"""
)
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = dedup.exact_groups(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "group_id")
    return splits.group_split(groups, "group_id").select("doc_id", "group_id", "split")


@query(
    """WITH p AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|42'), doc_id) - 1 AS n, count(*) OVER (PARTITION BY quality) AS size FROM labels)
SELECT doc_id, quality, n % 5 AS fold, n >= size - ceil(size * 0.15) AS is_validation FROM p"""
)
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = splits.stratified_folds(read(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")
    return splits.early_stop(folds, "quality", "doc_id").select("doc_id", "quality", "fold", "is_validation")


@query(
    """WITH s AS (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(strlen(text)) AS m2, stddev_pop(strlen(text)) AS s2 FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, round((n_chars - m1) / s1, 6) AS n_chars, round((strlen(text) - m2) / s2, 6) AS n_bytes FROM documents, s"""
)
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.octet_length("text").alias("n_bytes"))
    scaled = splits.scaled(rows, rows.where("doc_id % 5 <> 0"), ["n_chars", "n_bytes"])
    return scaled.select("doc_id", F.round("n_chars", 6).alias("n_chars"), F.round("n_bytes", 6).alias("n_bytes"))


# ---- metrics ----


@query("SELECT count(*) AS n, count_if(quality = 1)::BIGINT AS positives, count_if(quality = 0)::BIGINT AS negatives, count_if(quality = 0)::DOUBLE / greatest(count_if(quality = 1), 1) AS scale_pos_weight FROM labels")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_stats(read(spark, sf_dir, "labels"), "quality")


# A score in steps, so that ties matter, that leans to the label.
_SCORE = "(CAST(doc_id AS BIGINT) * 7919 % 83 + quality * 30) / 113.0"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", "quality", ((F.col("doc_id") * 7919 % 83 + F.col("quality") * 30) / F.lit(113.0)).alias("score"))


@query(
    f"""WITH s AS (SELECT quality AS y, ({_SCORE}) >= 0.5 AS p FROM labels), c AS (SELECT count_if(y = 1 AND p)::BIGINT AS tp, count_if(y = 0 AND p)::BIGINT AS fp, count_if(y = 1 AND NOT p)::BIGINT AS fn, count_if(y = 0 AND NOT p)::BIGINT AS tn FROM s)
SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM c"""
)
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_scores(spark, sf_dir), "quality", "score").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    f"""WITH s AS (SELECT quality AS y, ({_SCORE}) AS s FROM labels), b AS (SELECT s, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM s GROUP BY 1),
r AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pa, coalesce(sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS na FROM b)
SELECT round((sum(neg * (pa + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)))::DOUBLE, 6) AS roc_auc, round((sum(pos * (pa + pos) / (pa + pos + na + neg)::DOUBLE) / sum(pos))::DOUBLE, 6) AS average_precision FROM r"""
)
def roc_auc_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.curves(_scores(spark, sf_dir), "quality", "score").select(F.round("roc_auc", 6).alias("roc_auc"), F.round("average_precision", 6).alias("average_precision"))


# ---- embeddings, models ----


@query(
    """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, (vec_id % 3 <> 0)::INT AS m FROM embeddings),
p AS (SELECT label, i, sum(x * m) / greatest(sum(m), 1e-9) AS v FROM x GROUP BY 1, 2)
SELECT label, 2 * count(*) AS n_dims, round(2 * sum(v), 5) AS total, round(2 * sum(v * i), 4) AS shape FROM p GROUP BY 1"""
)
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label as the tokens of one text, pooled under a mask and joined with themselves as the two channels."""
    tokens = read(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    p = models.pooled(tokens, "label", "embedding", "mask").withColumn("both", models.joined_channels(F.col("pooled"), F.col("pooled")))
    weighed = F.aggregate(F.transform("pooled", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return p.select("label", F.size("both").cast("long").alias("n_dims"), F.round(F.aggregate("both", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(2 * weighed, 4).alias("shape"))


@query()
def text_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.embedded(read(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "embedding")


@query()
def page_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both text channels of each page under a small encoder of fixed weights, in batches, as one vector."""
    both = html_features.text_channels(read(spark, sf_dir, "pages"), "page_id", "html")
    return embedding.channels(both, "visible_text", "structural_core", "embedding").select("page_id", "embedding")


@query()
def pca_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return models.reduced(rows, models.reducer(rows.where("vec_id % 5 <> 0"), "v"), "v").select("vec_id", "reduced")


@query()
def umap_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A non-linear reduction to 8 numbers, fitted on four fifths of the vectors; the rest is placed among them."""
    rows = read(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    fitted = umap.laid(rows.where("vec_id % 5 <> 0"), "vec_id", "v", 8)
    return umap.placed(rows, fitted, "v").select("vec_id", "reduced")


def _numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the labelled texts, written once, as a fit goes over them several times."""
    rows = _labelled(spark, sf_dir)
    return stage(models.assembled(html_features.features(rows, "doc_id", "html").join(rows.select("doc_id", "label"), "doc_id"), fixed.FEATURES).select("doc_id", "label", "features"), "numeric")


@query()
def gbt_voter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.early_stop(_numeric(spark, sf_dir), "label", "doc_id")
    model = models.boosted_early(rows, "label", "doc_id", "is_validation")
    return boosting.probability(model, rows, "p").select("doc_id", "label", F.round("p", 6).alias("p"), tx.verdict(F.col("p")).alias("verdict"))


@query()
def tuned_voter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: 20 draws, 5 folds, up to 1,000 trees with a patience of 100; then the winner on all rows."""
    rows = _numeric(spark, sf_dir)
    params, trees, auc = models.tuned(rows, "label", "doc_id", models.drawn())
    model = models.boosted(rows, "label", "doc_id", trees=trees, params=params)
    told = {k: F.lit(v) for k, v in (("cv_auc", auc), ("trees", trees), *params.items())}
    return metrics.model_stats(boosting.probability(model, rows, "p"), "label", "p").withColumns(told)


@query()
def tree_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.early_stop(_numeric(spark, sf_dir), "label", "doc_id")
    return explain.tree_attributions(rows, models.boosted_early(rows, "label", "doc_id", "is_validation"), fixed.FEATURES, "doc_id")


def _two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    return read(spark, sf_dir, "labels").select("doc_id", "quality", ((F.col("doc_id") * 7919 % 83 + q * 30) / 113.0).alias("a"), ((F.col("doc_id") * 104729 % 97 + q * 20) / 117.0).alias("b"))


@query()
def meta_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_scores(spark, sf_dir)
    model = models.logistic(rows, "quality", ["a", "b"])
    return rows.select("doc_id", "quality", F.round(models.logistic_score(model, "a", "b"), 6).alias("p"), explain.blend_contributions(model, a=F.col("a"), b=F.col("b")).alias("contributions"))


@query()
def platt_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_scores(spark, sf_dir)
    return rows.select("doc_id", "quality", F.round(models.logistic_score(models.calibrator(rows, "quality", "a"), "a"), 6).alias("p"))


@query()
def loo_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_scores(spark, sf_dir)
    left = models.left_out(rows, models.logistic(rows, "quality", ["a", "b"]), "quality", ["a", "b"])
    return metrics.curves(stage(left, "loo"), "quality", "loo_score").withColumnRenamed("roc_auc", "loo_auc")


#: Where this session has saved the models of a folder's tables.
_SAVED: dict[tuple[str, str], str] = {}


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """Train with all of the search, and save the models where every executor reads them; (test rows, what training found)."""
    bundle, test, found = reports.train(_labelled(spark, sf_dir), "doc_id", "html", "label")
    path = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    bundle.save(spark, path, found)
    _SAVED[spark.sparkContext.applicationId, sf_dir] = path
    return test, found


def _bundle(spark: SparkSession, sf_dir: str) -> reports.Bundle:
    """The saved models of the folder's tables, trained first where this application has not yet done so."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _SAVED:
        _trained(spark, sf_dir)
    return reports.Bundle.load(spark, _SAVED[key])[0]


@query()
def train_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, found = _trained(spark, sf_dir)
    return reports.summary(test, "label", found)


@query()
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan(read(spark, sf_dir, "pages"), _bundle(spark, sf_dir), "page_id", "url", "html")


@query()
def pipeline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pipeline_report(landed(read(spark, sf_dir, "pages")), _bundle(spark, sf_dir), "page_id", "url", "html", "final_url")


def requests(pages: DataFrame) -> DataFrame:
    """A request for each page: every seventh lacks the URL, every eleventh is no JSON, every thirteenth asks for a page that isn't there."""
    body = F.when(F.col("page_id") % 7 == 0, "{}").when(F.col("page_id") % 11 == 0, "no json").when(F.col("page_id") % 13 == 0, F.lit('{"url": "nowhere.example"}')).otherwise(F.to_json(F.struct("url")))
    return pages.select(F.col("page_id").alias("request_id"), body.alias("body"))


@query()
def scan_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return reports.answered(requests(pages), landed(pages), _bundle(spark, sf_dir))


@query("SELECT page_id, (page_id % 2)::INTEGER AS label, regexp_replace(coalesce(html, ''), '\\r\\n?', chr(10), 'g') AS html, dense_rank() OVER (ORDER BY page_id % 2, page_id::VARCHAR) - 1 AS ordinal FROM pages")
def page_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files to class folders and read back; files sort by folder and name."""
    root = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    page_folder.write(read(spark, sf_dir, "pages").withColumn("label", F.col("page_id") % 2), root, "page_id", "label", "html")
    name = F.regexp_extract("path", r"([^/]+)\.html$", 1)
    return page_folder.read(spark, root).select(name.cast("long").alias("page_id"), "label", "html", "ordinal")
