"""A lenient element tree, and what is read from it: counts, depth, links and text pieces. Small helpers for Spark tasks."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from html.parser import HTMLParser

# Elements without content, and elements that end an open paragraph.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Elements that end open ones of these kinds, up to the elements that keep them apart.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "body")),
    "dt": (("dt", "dd"), ("dl", "body")),
    "dd": (("dt", "dd"), ("dl", "body")),
    "tr": (("tr", "td", "th"), ("table", "body")),
    "td": (("td", "th"), ("tr", "table", "body")),
    "th": (("td", "th"), ("tr", "table", "body")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table", "body")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table", "body")),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table", "body")),
    "option": (("option",), ("select", "body")),
}
_P_BOUNDS = ("div", "td", "th", "article", "section", "li", "form", "body")
_HEAD_ONLY = frozenset("title meta link base style script".split())
#: Characters of one element's text that a form's part or a link may be told by; those that are longer are dropped or cut at less.
LONGEST_PART = 2_000
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("attrs", "children", "first", "last", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Element | str] = []
        self.first = self.last = 0

    def all(self, *names: str) -> list[Element]:
        """Elements below this one in document order, by name where names are given."""
        out, todo = [], [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            if not names or e.name in names:
                out.append(e)
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]
        return out

    def strings(self) -> list[tuple[Element, str]]:
        out, todo = [], [(self, c) for c in reversed(self.children)]
        while todo:
            holder, c = todo.pop()
            if isinstance(c, str):
                out.append((holder, c))
            else:
                todo += [(c, x) for x in reversed(c.children)]
        return out

    def text(self) -> str:
        return " ".join(s for s in (x.strip() for _, x in self.strings()) if s)


class Remark(str):
    """A comment or declaration among an element's strings."""

    __slots__ = ()


class _Builder(HTMLParser):
    """html, head and body are always there; a comment is a string of the element that holds it, as it counts as text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.document = Element("[document]", {}, None)
        self.root = self._add(Element("html", {}, self.document))
        self.head: Element | None = None
        self.body: Element | None = None
        self.at = self.root
        # open elements by name, so that nothing is looked for in vain through a deep page
        self.opened: Counter[str] = Counter()

    def _up_to(self, e: Element) -> None:
        """Close all open elements up to e and e itself."""
        while self.at is not e:
            self.opened[self.at.name] -= 1
            self.at = self.at.parent
        self.opened[e.name] -= 1
        self.at = e.parent

    def _add(self, e: Element) -> Element:
        e.parent.children.append(e)
        return e

    def _place(self, tag: str) -> None:
        """Open head or body where the source leaves them out."""
        if self.body is None and tag in _HEAD_ONLY and self.at is self.root:
            self.head = self.head or self._add(Element("head", {}, self.root))
            self.at = self.head
        elif self.body is None and tag not in _HEAD_ONLY:
            self.body = self._add(Element("body", {}, self.root))
            self.at = self.body

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if tag == "html":
            self.root.attrs = given | self.root.attrs
            return
        if tag == "head":
            if self.head is None and self.body is None:
                self.head = self.at = self._add(Element("head", given, self.root))
            return
        if tag == "body":
            if self.body is None:
                self.body = self.at = self._add(Element("body", given, self.root))
            return
        self._place(tag)
        if tag in _ENDS_P:
            self._close(("p",), _P_BOUNDS)
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        e = self._add(Element(tag, given, self.at))
        if tag not in _VOID:
            self.at = e
            self.opened[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.at.name == tag:
            self._up_to(self.at)

    def _close(self, names: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """End the outermost open element of these names below the nearest bound."""
        if not any(self.opened[x] for x in names):
            return
        e, found = self.at, None
        while e.parent is not None and e.name not in bounds:
            if e.name in names:
                found = e
            e = e.parent
        if found is not None:
            self._up_to(found)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            self.at = self.root
            return
        if not self.opened[tag]:
            return
        e = self.at
        while e.parent is not None and e.name not in ("body", "html"):
            if e.name == tag:
                self._up_to(e)
                return
            e = e.parent

    def handle_data(self, data: str) -> None:
        if self.body is None and self.at in (self.root, self.head):
            if not data.strip():
                return
            self._place("")
        self.at.children.append(data)

    def handle_comment(self, data: str) -> None:
        self.at.children.append(Remark(data))

    def handle_decl(self, decl: str) -> None:
        self.document.children.insert(0, Remark(decl[7:].strip() if decl.lower().startswith("doctype") else decl))


def parse(page: str) -> Element:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.document


class Texts:
    """Texts of all elements of a document: its strings in order, of which each element has a run. Nested elements share theirs."""

    def __init__(self, document: Element):
        self.strings: list[str] = []
        self.ends = [0]
        todo: list[tuple[Element | str, bool]] = [(document, False)]
        while todo:
            node, done = todo.pop()
            if isinstance(node, str):
                said = node.strip()
                if said:
                    self.strings.append(said)
                    self.ends.append(self.ends[-1] + len(said) + 1)
            elif done:
                node.last = len(self.strings)
            else:
                node.first = len(self.strings)
                todo.append((node, True))
                todo += [(c, False) for c in reversed(node.children)]

    def of(self, e: Element) -> str:
        return " ".join(self.strings[e.first : e.last])

    def short(self, e: Element, most: int) -> str:
        """The text if it has at most so many characters; else as much of it as tells that it has more."""
        last = e.last
        if self.ends[last] - self.ends[e.first] > 2 * most:
            last = bisect.bisect_right(self.ends, self.ends[e.first] + 2 * most)
        return " ".join(self.strings[e.first : min(last, e.last)])


def depth(document: Element) -> int:
    most, todo = 0, [(document, 0)]
    while todo:
        e, d = todo.pop()
        most = max(most, d)
        todo += [(c, d + 1) for c in e.children if isinstance(c, Element)]
    return most


def squeezed(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def body_text(page: str) -> str:
    """The body's text as it stands, without remarks, scripts, styles, templates and ruby notes."""
    body = parse(page).all("body")
    return "".join(s for e, s in body[0].strings() if not isinstance(s, Remark) and e.name not in ("script", "style", "template", "rt", "rp")) if body else ""


def counts(page: str, tags: list[str]) -> dict[str, int]:
    """Element counts, distinct names, depth, length of the visible text and links of a page."""
    document = parse(page)
    every = document.all()
    names = [e.name for e in every]
    shown = [t for t in (s.strip() for e, s in document.strings() if e.name not in ("script", "style", "noscript")) if t]
    hrefs = [e.attrs["href"].strip() for e in every if e.name == "a" and "href" in e.attrs]
    real = [h for h in hrefs if h and not h.startswith(("#", "javascript"))]
    outside = sum(h.startswith(("http://", "https://")) for h in real)
    return {f"count_tag__{t}": names.count(t) for t in tags} | {
        "num_unique_tags": len(set(names)),
        "max_dom_depth": depth(document),
        "visible_len": len(squeezed(" ".join(shown))),
        "count_external_links": outside,
        "count_internal_links": len(real) - outside,
    }


def pieces(page: str) -> dict:
    """The raw text pieces that the two text channels are put together from."""
    document = parse(page)
    texts = Texts(document)
    title, first = document.all("title"), lambda xs: xs[0] if xs else None
    metas = document.all("meta")
    described = first([m for m in metas if "description" in m.attrs.get("name", "").lower()])
    form = first(document.all("form"))
    if form is not None:
        around = form.parent if form.parent.name not in ("body", "html", "[document]") else form
        said = []
        for e in around.all("label", "input", "button", "select", "textarea", "a", "p", "span"):
            said.append({"kind": "text", "text": squeezed(texts.short(e, LONGEST_PART))})
            said += [{"kind": "attr", "text": e.attrs.get(k, "")} for k in ("placeholder", "value", "name", "aria-label")]
    else:
        said = [{"kind": "plain", "text": squeezed(texts.short(e, LONGEST_PART))} for e in document.all("a", "button")]
    foot = first(document.all("footer")) or first([e for e in document.all() if re.search("footer|legal|disclaimer|copyright", e.attrs.get("class", ""), re.I)])
    return {
        "title": texts.of(title[0]) if title else None,
        "description": described.attrs.get("content") if described is not None else None,
        "headings": [texts.of(h) for h in document.all("h1", "h2", "h3")],
        "form_parts": said,
        "footer": [texts.of(foot)] if foot is not None else [squeezed(texts.of(p)) for p in document.all("p")[-5:]],
        "metas": [{"name": (m.attrs.get("name") or m.attrs.get("property") or "").lower(), "content": m.attrs.get("content", "")} for m in metas],
        "forms": [
            {
                "action": f.attrs.get("action", ""),
                "method": f.attrs.get("method") or "get",
                "enctype": f.attrs.get("enctype", ""),
                "inputs": [i.attrs.get("name") or i.attrs.get("type") or "" for i in f.all("input")],
            }
            for f in document.all("form")
        ],
        "links": [{"href": a.attrs["href"], "text": texts.short(a, LONGEST_PART)} for a in document.all("a") if "href" in a.attrs],
        "images": [{"src": i.attrs.get("src", ""), "alt": i.attrs.get("alt", "")} for i in document.all("img")],
    }
