"""HTML pages: a small tree builder on the standard tokenizer, main content and page parts.

Everything a page gives is taken in one Arrow function, so that a page crosses
to Python once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("template noscript style script".split())
CHUNKS = frozenset("pre blockquote figcaption caption th td dd dt li p".split()) | {f"h{k}" for k in range(1, 7)}
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
#: An opening tag ends the nearest open element of the set, unless one of the stops is nearer.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form header hr h6 h5 h4 h3 h2 h1 main menu nav ol p pre section table ul".split())

DROP_TAGS = frozenset("nav aside form dialog button".split())
DROP_CLASSES = frozenset(
    "toc printfooter vertical-navbox navbox mw-editsection comments login-form consent-banner cookie-consent cookie-banner recommended related-posts "
    "share-buttons social-share ads advert advertisement pager pagination breadcrumbs breadcrumb sidebar site-footer site-header".split()
)
DROP_IDS = frozenset("toc comments breadcrumbs sidebar footer site-footer site-header".split())
STRONG_CLASSES = frozenset("mw-parser-output main-content article-content post-content entry-content".split())
STRONG_IDS = frozenset("mw-content-text main-content main content".split())
GOOD = tuple("mw-parser-output body text story entry post main content article".split())
BAD = tuple("breadcrumb toolbar search login social share cookie advert promo recommend related comment footer sidebar menu nav".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "sums")

    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children, self.sums = tag, attrs, parent, [], (0, 0, 0, 0, 0, 0)

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                stack.extend(reversed(n.children))
            else:
                yield n

    def words(self) -> str:
        """Text pieces trimmed and joined by blanks, blanks collapsed."""
        return " ".join(" ".join(self.strings()).split())

    def joined(self) -> str:
        """Text pieces as they stand, blanks collapsed."""
        return " ".join("".join(self.strings()).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.head, self.body = Node("head", {}, self.root), Node("body", {}, self.root)
        self.root.children = [self.head, self.body]
        self.open = [self.head]

    def _close(self, names, stops=()) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in names:
                del self.open[k:]
                return
            if self.open[k].tag in stops:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "head", "body"):
            target = {"html": self.root, "head": self.head, "body": self.body}[tag]
            target.attrs = own | target.attrs
            if tag == "body" and self.open[0] is self.head:
                self.open = [self.body]
            return
        if self.open[0] is self.head and len(self.open) == 1 and tag not in HEAD_ONLY:
            self.open = [self.body]
        if tag in ENDS_P:
            self._close({"p"}, {"button", "table", "td", "th"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        node = Node(tag, own, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head" and self.open[0] is self.head:
            self.open = [self.body]
        elif tag == "br":
            self.handle_starttag("br", [])
        else:
            self._close({tag})

    def handle_data(self, data: str) -> None:
        if self.open[0] is self.head and len(self.open) == 1:
            if not data.strip():
                return
            self.open = [self.body]
        self.open[-1].children.append(data)


def parse(markup: str) -> _Builder:
    b = _Builder()
    b.feed(markup)
    b.close()
    return b


def _strip(root: Node, unwanted) -> None:
    """Cuts every unwanted element off the tree."""
    stack = [root]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if not (isinstance(c, Node) and unwanted(c))]
        stack.extend(c for c in n.children if isinstance(c, Node))


def _classes(n: Node) -> set[str]:
    return set(n.attrs.get("class", "").split())


def _boilerplate(n: Node) -> bool:
    a = n.attrs
    return (
        n.tag in DROP_TAGS
        or "hidden" in a
        or a.get("aria-hidden") == "true"
        or a.get("role") in ("navigation", "complementary")
        or (n.tag in ("header", "footer") and n.parent is not None and n.parent.tag == "body")
        or bool(_classes(n) & DROP_CLASSES)
        or a.get("id") in DROP_IDS
    )


def _strong(n: Node) -> bool:
    return n.tag == "main" or n.attrs.get("role") == "main" or n.attrs.get("id") in STRONG_IDS or bool(_classes(n) & STRONG_CLASSES)


def _add_up(root: Node) -> list[Node]:
    """Sets the ``sums`` of all nodes, from the leaves up; the nodes below root in page order.

    sums: characters in words, words, and of the nodes below the size of links and of paragraphs, the number of
    paragraphs and of headings.
    """
    nodes = list(root.walk())
    for n in (*reversed(nodes), root):
        chars = words = links = paragraphs = count = heads = 0
        for c in n.children:
            if isinstance(c, Node):
                own = c.sums
                size = _size(c)
                chars, words = chars + own[0], words + own[1]
                links += own[2] + (size if c.tag == "a" else 0)
                paragraphs += own[3] + (size if c.tag == "p" else 0)
                count += own[4] + (c.tag == "p")
                heads += own[5] + (c.tag in ("h1", "h2", "h3"))
            else:
                pieces = c.split()
                chars, words = chars + sum(map(len, pieces)), words + len(pieces)
        n.sums = (chars, words, links, paragraphs, count, heads)
    return nodes


def _size(n: Node) -> int:
    """Characters of ``words``."""
    return n.sums[0] + max(n.sums[1] - 1, 0)


def content_score(n: Node) -> float:
    """How much a container (with sums) looks like the page's main content; minus infinity below 80 characters."""
    size = _size(n)
    if size < 80:
        return float("-inf")
    _, _, links, paragraphs, count, heads = n.sums
    score = size * (1 - 0.85 * min(links / size, 1.0))
    score += 0.5 * min(paragraphs, 8000) + 35 * min(count, 30) + 60 * min(heads, 10)
    score += {"main": 1200, "article": 600}.get(n.tag, 0) + (1000 if n.attrs.get("role") == "main" else 0)
    hints = " ".join(v for v in map(n.attrs.get, ("id", "class", "role")) if v).lower()
    return score + 500 * any(h in hints for h in GOOD) - 1000 * any(h in hints for h in BAD)


def _best(nodes: list[Node]) -> Node | None:
    scored = [(content_score(n), n) for n in nodes]
    best = max(scored, key=lambda x: x[0], default=(0.0, None))
    return best[1] if best[0] > 0 else None


def _chunks(root: Node) -> Iterator[Node]:
    """The outermost text blocks below root."""
    stack = [c for c in reversed(root.children) if isinstance(c, Node)]
    while stack:
        n = stack.pop()
        if n.tag in CHUNKS:
            yield n
        else:
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))


def _breaks_to_blanks(root: Node) -> None:
    stack = [root]
    while stack:
        n = stack.pop()
        n.children = [" " if isinstance(c, Node) and c.tag == "br" else c for c in n.children]
        stack.extend(c for c in n.children if isinstance(c, Node))


def main_text(tree: _Builder) -> str:
    """The page's main text; changes the tree."""
    _strip(tree.root, lambda n: n.tag in RAW)
    _strip(tree.root, _boilerplate)
    body = tree.body
    inner = _add_up(body)
    root = _best([n for n in inner if _strong(n)]) or _best([n for n in inner if n.tag in ("article", "section", "div")]) or body
    _breaks_to_blanks(root)
    chunks: list[str] = []
    heading = next((n for n in inner if n.tag == "h1"), None)
    above = heading
    while above is not None and above is not root:
        above = above.parent
    if heading is not None and above is None and heading.joined():
        chunks.append(heading.joined())
    for n in _chunks(root):
        t = n.joined()
        if t and (not chunks or chunks[-1] != t):
            chunks.append(t)
    return " ".join(chunks) if chunks else root.words()


FIELDS = {"title": "string", "language": "string", "description": "string", "h1": "string", "links": "array<struct<href:string,anchor:string>>", "text": "string", "main_text": "string"}
_LINKS = pa.list_(pa.struct([("href", pa.string()), ("anchor", pa.string())]))


def page_fields(tree: _Builder, fields: tuple[str, ...] = tuple(FIELDS)) -> dict:
    """The asked of title, declared language, description, h1, links, body text and main text; changes the tree."""
    nodes = list(tree.root.walk()) if set(fields) & {"title", "description", "h1", "links"} else []
    first = lambda tag: next((n.joined() for n in nodes if n.tag == tag), "")
    meta = lambda key, value: next((t for n in nodes if n.tag == "meta" and n.attrs.get(key, "").lower() == value and (t := " ".join(n.attrs.get("content", "").split()))), "")

    def text() -> str:
        _strip(tree.root, lambda n: n.tag in RAW)
        return tree.body.words()

    def language() -> str:
        lang = tree.root.attrs.get("lang", "").strip().lower()[:2]
        return lang if lang in ("en", "de") else "unknown"

    take = {
        "title": lambda: first("title"),
        "language": language,
        "description": lambda: meta("name", "description") or meta("property", "og:description"),
        "h1": lambda: first("h1"),
        "links": lambda: [{"href": n.attrs["href"], "anchor": n.words()} for n in nodes if n.tag == "a" and n.attrs.get("href")],
        "text": text,
        "main_text": lambda: main_text(tree),
    }
    return {name: f() for name, f in take.items() if name in fields}


def parse_pages(pages: DataFrame, key: str = "url", body: str = "html", fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """(key, fields...), a row a page, each page parsed once; NULL markup counts as empty."""
    kind = pages.schema[key].dataType.simpleString()
    names = [f for f in FIELDS if f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [page_fields(parse(markup or ""), tuple(names)) for markup in b.column(1).to_pylist()]
            columns = [pa.array([r[f] for r in rows], _LINKS if f == "links" else pa.string()) for f in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[key, *names])

    return pages.select(key, body).mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{f} {FIELDS[f]}" for f in names)]))


def plain(markup: str) -> str:
    """Main text of one page, for callers without Spark."""
    return main_text(parse(markup))
