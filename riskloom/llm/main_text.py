"""HTML extraction with site template removal.

Every element's subtree is hashed, its words and structure; Spark counts each hash over the distinct contents of a host's pages, and subtrees that recur in most of
them are deleted; copies of a page are no evidence of a template. What elements and their names tell of menus, notices, adverts and the like goes as well.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, slices, stage
from .url_filters import host_of

#: A subtree is the site's, not the page's, from so many pages of a host on that are also more than this share of its pages. Pages that differ in no text but what the rules drop are one.
PAGES, SHARE = 5, 0.5
#: Hosts and hashes that may be broadcast together; beyond, the join shuffles.
FEW = 500_000
#: Bytes of html that are Python strings together.
HELD = 1 << 20

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: What is after the last tag's end: a remark without an end of its own takes all the rest.
_OPEN_REMARK = re.compile(r"<[!?]")
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never of the main text, by name or by role.
_OUT = frozenset("nav footer aside form button select option dialog menu head svg math canvas object audio video fieldset search".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of classes and ids that mark what isn't main text.
_OUT_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice newsletter subscribe signup popup modal overlay menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar footer masthead comment comments disqus respond replies related recommended share sharing social widget toolbar pagination pager skip login".split()
)
#: Of these, words that mean other things as well, and words that may stand beside them without changing what they mark; with any other word (share-price, social-history) it is a name of the page's own.
_DOUBTFUL = frozenset("share sharing social related recommended notice promotion sponsor comment respond replies consent menu skip login search subscribe widget toolbar overlay footer".split())
_PLAIN_WORDS = frozenset(
    "also area articles bar block body bottom box btn button buttons col column container content count desktop email facebook first fixed footer form group header icon icons inner item items js last layout left link links list main middle mobile module "
    "more news no outer page panel policy post posts print primary read reply right row section secondary site slot sticky stories text thread title tools top twitter unit user wrap wrapper global local".split()
)
#: Heads of pages by these words too, but not inside an article.
_HEAD_WORDS = frozenset(["header"])
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
#: An element that ends an open one of its kind, up to the elements that keep them apart.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_LISTS = ("ul", "ol", "menu")
_APART = frozenset("article body div html main section table td th".split())


class _Open:
    __slots__ = ("block", "level", "link", "out", "parts", "tag")

    def __init__(self, tag: str, out: bool, level: int, block: int, link: bool):
        self.tag, self.out, self.level, self.block, self.link = tag, out, level, block, link
        self.parts: list[str] = []


def _dropped(tag: str, attributes: str, level: int) -> bool:
    if tag in _OUT or tag == "header" and not level:
        return True
    if not attributes:
        return False
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for one in value.split():
                words = {x.lower() for x in _PARTS.split(one) if x}
                marks = words & _OUT_WORDS or not level and words & _HEAD_WORDS
                sure = words & (_OUT_WORDS - _DOUBTFUL) or words <= _OUT_WORDS | _PLAIN_WORDS | _HEAD_WORDS
                if tag not in ("html", "body", "article", "main") and marks and sure or tag == "article" and words & {"comment", "comments"}:
                    return True
        elif name == "role" and value.lower() in _OUT_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(page: str, template: Callable[[int], bool]) -> list[str]:
    """The blocks of main text of a page: those of main with the articles in it or of other articles, whichever have more text; on a page without text in either, of the rest but list entries that are mostly links.

    template is asked with each closed element's hash, if text is in it, whether to delete it.
    """
    out: list[tuple[str, int, float]] = []
    text: list[str] = []
    linked = 0
    stack = [_Open("", False, 0, 0, False)]
    opened: Counter[str] = Counter()  # open elements by name, so that no end or sibling is looked for in vain through a deep page
    last = page.rfind(">")  # what opens after it is no tag

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join("".join(text).split())
            if said:
                out.append((said, stack[-1].level, linked / len(said) if any(opened[x] for x in _LISTS) else 0.0))
                stack[-1].parts.append(said)
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            flush()
            node = stack.pop()
            opened[node.tag] -= 1
            if node.parts:
                h = xxhash.xxh3_64_intdigest("\0".join([node.tag, *node.parts]).encode("utf-8", "surrogatepass"))
                if template(h):
                    del out[node.block :]
                else:
                    stack[-1].parts.append(f"{h:x}")

    at, end, lower = 0, len(page), ""
    links = 0
    while at < end:
        m = _TAG.search(page, at, last + 1) if at <= last else None
        m = m or _OPEN_REMARK.search(page, max(at, last))
        said = page[at : m.start() if m else end]
        if said and not stack[-1].out:
            said = html.unescape(said) if "&" in said else said
            text.append(said)
            linked += len(said) * bool(links)
        if not m:
            break
        at = m.end()
        if m.re is _OPEN_REMARK or m[0].startswith("<!--") and not m[0].endswith("->") and not m[0].endswith("-!>"):
            break
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            links -= tag == "a" and links > 0
            if tag in _INLINE and stack[-1].tag in _APART and not stack[-1].out:
                continue
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE or tag in ("p", "li") and stack[k].tag in _APART:
                    break
            continue
        if tag in _RAW:
            lower = lower or page.lower()
            stop = lower.find(f"</{tag}", at)
            at = end if stop < 0 else stop
            continue
        if stack[-1].tag == "head" and tag not in ("meta", "link", "base"):
            close(len(stack) - 1)
        if tag == "br":
            text.append(" ") if not stack[-1].out else None
            continue
        if tag in _CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in _INLINE:
                    break
        if tag in _SIBLINGS:
            kinds, bounds = _SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in kinds) else ():
                if stack[k].tag in kinds:
                    close(k)
                    break
                if stack[k].tag in bounds:
                    break
        if tag in _VOID:
            flush() if tag == "hr" else None
            continue
        top = stack[-1]
        attributes = m[3] if m[2] else m[6]
        if tag in _INLINE:
            links += tag == "a"
            if not top.out and not _dropped(tag, attributes, top.level):
                continue
        else:
            flush()
        if attributes.endswith("/") and tag not in _CLOSES_P:
            continue
        level = top.level or (2 if tag == "article" else 1 if tag == "main" or re.search(r"""role\s*=\s*["']?main\b""", attributes) else 0)
        gone = top.out or _dropped(tag, attributes, top.level)
        stack.append(_Open(tag, gone, level, len(out), False))
        opened[tag] += 1
    close(1)
    flush()
    amount: Counter[int] = Counter()
    for said, level, _ in out:
        amount[level] += len(said) if level else 0
    best = max(amount, key=lambda x: (amount[x], x), default=0)
    return [said for said, level, share in out if level == best and (best or share <= 0.5)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pages_from: int = PAGES, share: float = SHARE) -> DataFrame:
    """(id, url, text, n_chars) per page: blocks of the main text in page order, joined by line ends.

    Null html is empty and gives empty text, as does a page without main text. Pages without a host in their URL have no site, so that no template is cut from them. Character references are decoded, white space
    in a block is one space. Repeated pages stay repeated, and count once for templates. An empty table gives no rows; other columns are not read.
    """
    rows = bounded_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    host = F.coalesce(host_of(F.col("url")), F.lit(""))
    rows = rows.withColumn("host", F.when(host != "", F.xxhash64(host)))
    sited = rows.where("host is not null")
    # the null tree stands for the page itself
    trees = sited.select("host", "html").mapInArrow(_subtrees, "host long, tree long, content long").groupBy("host", "tree").agg(F.countDistinct("content").alias("n"))
    trees = stage(trees.where((F.col("n") >= pages_from) | F.col("tree").isNull()), "trees")
    seen = trees.where("tree is not null")
    sizes = trees.where("tree is null").select("host", F.col("n").alias("pages"))
    recurring = seen.join(sizes, "host").where(F.col("n") > F.col("pages") * share).groupBy("host").agg(F.collect_list("tree").alias("trees"))
    recurring = stage(recurring, "templates")
    held = recurring.agg(F.count("*"), F.coalesce(F.sum(F.size("trees")), F.lit(0))).first()
    known = F.broadcast(recurring) if sum(held) <= FEW else recurring
    kinds = dict(rows.dtypes)
    return rows.join(known, "host", "left").select("id", "url", "html", "trees").mapInArrow(_extracted, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, tree, content): the subtrees of each distinct content, and a null tree for the content itself: what the rules leave of a page, or its html where that is nothing."""
    signed = lambda h: h - (h >> 63 << 64)
    for batch in (part for whole in batches for part in slices(whole, 1, HELD)):
        seen: set[tuple[int, int | None, int]] = set()
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found: set[int] = set()
            said = blocks(page, lambda h: found.add(h))  # noqa: B023
            whole = "\n".join([*map(str, sorted(found)), *said]) or page
            content = signed(xxhash.xxh3_64_intdigest(whole.encode("utf-8", "surrogatepass")))
            seen.add((host, None, content))
            seen.update((host, signed(h), content) for h in found)
        host, tree, content = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (host, tree, content)], ["host", "tree", "content"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    @lru_cache(maxsize=64)
    def templates(trees: bytes) -> frozenset[int]:
        return frozenset(np.frombuffer(trees, np.int64).view(np.uint64).tolist())

    for batch in (part for whole in batches for part in slices(whole, 2, HELD)):
        texts = []
        for page, trees in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            known = templates(trees.values.to_numpy().tobytes() if trees.is_valid else b"")
            texts.append("\n".join(blocks(page, known.__contains__)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])
