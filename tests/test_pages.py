import os
import time

import pytest
from pyspark.sql import functions as F

from riskloom.functions import dom, fixed
from riskloom.operators import html_features, reports
from riskloom.sources import page_folder, pages as source

PAGE = (
    '<html><head><title>PayPal login</title></head><body><form action="https://x.com/login" method="post"><input name="Email"><input type="password"></form>'
    '<a href="https://x.com/about">About</a><a href="/in">In</a><a href="#t">T</a><a href="mailto:a@b">M</a></body></html>'
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "<p>a<p>b<!-- c --><br>")], "page_id long, html string")


def test_features_of_a_page_counted_by_hand(rows):
    got = {r.page_id: r.asDict() for r in html_features.features(rows, "page_id", "html").collect()}
    one = got[1]
    assert one.pop("shannon_entropy") == pytest.approx(4.703082, abs=1e-6)
    want = dict.fromkeys(fixed.FEATURES, 0) | {"raw_len": 268, "count_tag__a": 4, "count_tag__form": 1, "count_tag__input": 2, "num_unique_tags": 7, "max_dom_depth": 4, "visible_len": 25, "count_external_links": 1, "count_internal_links": 2}
    want.pop("shannon_entropy")
    assert one == want | {"page_id": 1}
    assert got[2]["shannon_entropy"] == got[3]["shannon_entropy"] == 0.0


def test_channels_of_a_page(rows):
    got = {r.page_id: r for r in html_features.text_channels(rows, "page_id", "html").collect()}
    assert got[1].visible_text == "PAGE TITLE [BRAND] [ACTION] FORM CONTENT Email"
    assert got[1].structural_core == "TITLE [BRAND] [ACTION] FORM action=URL_EXT_SENSITIVE method=POST FORM_INPUTS email password LINKS URL_EXT About | URL_INT In | URL_ANCHOR T | URL_MAIL M"
    assert (got[2].visible_text, got[2].structural_core) == ("", "")
    assert got[4].visible_text == "FOOTER a b c"


def test_unclosed_elements_make_siblings():
    document = dom.parse("<ul><li>a<li>b</ul><p>x<div>y</div>")
    assert [e.name for e in document.all()] == ["html", "body", "ul", "li", "li", "p", "div"]
    assert dom.depth(document) == 4


def test_pattern_counts_agree_with_the_tree(spark, sf001):
    pages = spark.read.parquet(f"{sf001}/pages.parquet")
    tags = html_features.tag_counts(pages, "page_id", "html").join(html_features.link_counts(pages, "page_id", "html"), "page_id")
    tree = html_features.dom_features(pages, "page_id", "html").select(*tags.columns)
    assert tags.exceptAll(tree).count() == 0


def test_labelled_pages(spark, tmp_path):
    for name, data in (("Phish/a/x.html", b"a\r\nb"), ("Phish/y.htm", "é".encode()), ("NotPhish/z.html", b"\xe9"), ("NotPhish/no.txt", b"q"), ("loose.html", b"q")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    got = {os.path.basename(r.path): (r.label, r.html) for r in source.labelled_pages(spark, str(tmp_path)).collect()}
    assert got == {"x.html": (1, "a\nb"), "y.htm": (1, "é"), "z.html": (0, "é")}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        source.labelled_pages(spark, str(tmp_path / "missing")).count()


def test_diagnosis(spark):
    rows = spark.createDataFrame([(1, "http://a.com", "http://b.com/", "x cf_chl_opt\ny"), (2, "http://a.com", "http://a.com/", "THIS DOMAIN IS PARKED")], "id long, url string, last string, html string")
    got = reports.diagnose(rows, "id", "url", "html", "last", head=1).orderBy("id").collect()
    assert [(r.redirected, r.domain_changed, r.challenges, r.parked, r.n_lines) for r in got] == [(True, True, ["cf_chl_opt"], [], 2), (False, False, [], ["This domain is parked"], 1)]
    assert got[0].head == "x cf_chl_opt"


def test_body_text_is_without_remarks_and_scripts():
    page = "<!doctype html><head><title>t</title></head><body>a <!-- c --><b>b</b><script>s</script><style>z</style><p>d</body>"
    assert dom.body_text(page) == "a bd"
    assert dom.body_text("plain text") == "plain text"
    assert dom.body_text("") == ""


def test_class_folders_are_sorted_and_packed(spark, tmp_path):
    for name, data in (("Phish/a/x.html", b"a\r\nb"), ("Phish/y.htm", "é".encode()), ("NotPhish/z.html", b"\xe9\r"), ("NotPhish/no.txt", b"q"), ("loose.html", b"q"), ("other/A.html", b"")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    rows = page_folder.read(spark, str(tmp_path), 2 * page_folder.OPENING)
    assert rows.rdd.getNumPartitions() == 2
    got = [(r.ordinal, os.path.relpath(r.path, tmp_path), r.label, r.html) for r in rows.orderBy("ordinal").collect()]
    assert got == [(0, "NotPhish/z.html", 0, "é\n"), (1, "Phish/a/x.html", 1, "a\nb"), (2, "Phish/y.htm", 1, "é"), (3, "other/A.html", 0, "")]
    with pytest.raises(Exception, match="missing"):
        page_folder.read(spark, str(tmp_path / "missing")).count()
    table = spark.createDataFrame([(1, 1, "x"), (2, 0, None), (3, None, "y")], "id long, label int, html string")
    page_folder.write(table, str(tmp_path / "out"), "id", "label", "html")
    assert [(r.label, r.html) for r in page_folder.read(spark, str(tmp_path / "out")).orderBy("ordinal").collect()] == [(0, ""), (0, "y"), (1, "x")]


def test_titles_hrefs_and_null_pages(spark):
    page = "<TITLE>\n A &amp; B </title><a class=x href='/one'>1</a><a href=https://x.org/2>2</a><a data-href=no>3</a><a href=\"\">4</a>"
    rows = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [r.t for r in rows.select(html_features.title_of("html").alias("t")).collect()] == ["A & B", ""]
    assert [r.h for r in rows.select(html_features.hrefs(F.col("html")).alias("h")).collect()] == [["/one", "https://x.org/2", ""], []]
    assert [(r.count_external_links, r.count_internal_links) for r in html_features.link_counts(rows, "page_id", "html").orderBy("page_id").collect()] == [(1, 1), (0, 0)]
    assert html_features.tag_counts(rows, "page_id", "html").where("page_id = 2").first().count_tag__a == 0
    assert reports.diagnose(rows.withColumn("url", F.lit("u")), "page_id", "url", "html").where("page_id = 2").first().n_lines == 1


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table><tr><td>1<td>2<tr><th>3</table>", "table(tr(td td) tr(th))"),
        ("<table><thead><tr><td>1<tbody><tr><td>2</table>x", "table(thead(tr(td)) tbody(tr(td)))"),
        ("<dl><dt>a<dd>b<dt>c</dl><select><option>1<option>2</select>", "dl(dt dd dt) select(option option)"),
        ("<p>a<b>c</p>d</b></i>", "p(b)"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "ul(li(ul(li)) li)"),
        ("<table><tr><td><table><tr><td>in</table><td>out</table>", "table(tr(td(table(tr(td))) td))"),
    ],
)
def test_elements_end_as_the_rules_say(page, want):
    shape = lambda e: e.name + ("(" + " ".join(map(shape, kids)) + ")" if (kids := [c for c in e.children if isinstance(c, dom.Element)]) else "")
    (body,) = dom.parse(page).all("body")
    assert " ".join(shape(c) for c in body.children if isinstance(c, dom.Element)) == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</span></p></td>" * 40_000, "<form>" + "<span>" * 20_000 + "x", "<li>" * 100_000, "<td>a" * 100_000, "<a href=x>" * 30_000, "<p><b>" * 50_000])
def test_deep_pages_take_no_more_than_their_length(page):
    began = time.process_time()
    dom.counts(page, fixed.COUNTED_TAGS), dom.pieces(page)
    assert time.process_time() - began < 8


def test_texts_of_nested_elements():
    document = dom.parse("<p>a<b> c <i>d</i></b></p><p></p>")
    texts = dom.Texts(document)
    assert [texts.of(e) for e in document.all("p", "b", "i")] == ["a c d", "c d", "d", ""] == [e.text() for e in document.all("p", "b", "i")]
    assert [len(texts.short(e, 1)) > 1 for e in document.all("p", "i")] == [True, False, False]


def test_a_reference_cut_short_stays_in_a_title(spark):
    rows = spark.createDataFrame([("<title>a&amp;&amp;&amp</title>",), ("<title>&lt;b&gt; &amp;lt; &#65;&copy x&copy;</title>",)], "html string")
    assert [r.t for r in rows.select(html_features.title_of("html").alias("t")).collect()] == ["a&&&amp", "<b> &lt; A&copy x©"]
