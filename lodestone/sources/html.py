"""HTML to text, links and canonical urls: one pass of the standard parser a page, a few pages of an Arrow batch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.batches import map_slices
from lodestone.functions import urls as U

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is left out of a text and where it is looked for, by crawl and by document rules, and links that lead nowhere.
CRAWL = {"drop": ("script", "style", "noscript", "template", "nav", "header", "footer"), "roots": (("main", None), ("div", "body"), ("article", None), ("body", None)), "squeeze": True}
DOCS = {"drop": ("script", "style"), "roots": (("div", "body"), ("main", None), ("div", "document"), ("body", None)), "squeeze": False}
_SKIP = ("javascript:", "mailto:", "tel:", "#")


class Node:
    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.attrs, self.inside = tag, attrs, []

    def find(self, tag: str, cls: str | None = None) -> Node | None:
        """The first element below, in document order."""
        todo = list(reversed(self.inside))
        while todo:
            n = todo.pop()
            if isinstance(n, Node):
                if n.tag == tag and (cls is None or cls in (n.attrs.get("class") or "").split()):
                    return n
                todo.extend(reversed(n.inside))
        return None

    def texts(self, drop: tuple[str, ...] = ()) -> Iterator[str]:
        todo = list(reversed(self.inside))
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in drop:
                todo.extend(reversed(n.inside))


class _Tree(HTMLParser):
    """An end tag closes the nearest open element of its name; one without is dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.links: list[str] = []
        self.canonical: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, dict(attrs))
        self.open[-1].inside.append(node)
        if tag not in _VOID:
            self.open.append(node)
        if tag == "a" and node.attrs.get("href") is not None:
            self.links.append(node.attrs["href"])
        if tag == "link" and self.canonical is None and "canonical" in (node.attrs.get("rel") or "").split() and node.attrs.get("href"):
            self.canonical = node.attrs["href"]

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].inside.append(data)


def parse(html: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree


def extract(tree: _Tree, rules: dict) -> tuple[str, str]:
    """(title, content). A title element counts even if it is blank; else the first h1."""
    title, head = "", tree.root.find("title")
    if head is not None and len(head.inside) == 1 and isinstance(head.inside[0], str):
        title = head.inside[0].strip()
    elif (h1 := tree.root.find("h1")) is not None:
        title = " ".join(x.strip() for x in h1.texts() if x.strip())
    root = next((n for tag, cls in rules["roots"] if (n := tree.root.find(tag, cls)) is not None), None)
    pieces = [x.strip() for x in root.texts(rules["drop"])] if root is not None else []
    content = " ".join(p for p in pieces if p)
    if rules["squeeze"]:
        content = re.sub(r"\s+", " ", content).strip() or title
    return title, content


def _typed(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def extracted(pages: DataFrame, rules: dict = CRAWL, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, title, content)."""

    def over(ids: list, texts: list) -> tuple[list, ...]:
        both = [extract(parse(h), rules) for h in texts]
        return ids, [t for t, _ in both], [c for _, c in both]

    return map_slices(pages.selectExpr(f"cast({id_col} AS long) AS page_id", f"{html_col} AS html"), over, _typed("page_id long, title string, content string"))


def resolved(href: str, base: str) -> str | None:
    href = href.strip()
    if not href or href.lower().startswith(_SKIP):
        return None
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def links(pages: DataFrame) -> DataFrame:
    """(page_id, link_no, link): absolute links of each page in order."""

    def over(ids: list, urls: list, texts: list) -> tuple[list, ...]:
        rows = [(p, i, x) for p, u, h in zip(ids, urls, texts, strict=True) for i, x in enumerate(filter(None, (resolved(r, u or "") for r in parse(h).links)))]
        return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

    return map_slices(pages.select(F.col("page_id").cast("long"), "url", "html"), over, _typed("page_id long, link_no long, link string"))


def named(pages: DataFrame) -> DataFrame:
    """(url, title, content, links) of fetched pages (url, place, html): a page goes by the canonical url that it names, else by its place; links are absolute."""

    def over(places: list, texts: list) -> tuple[list, ...]:
        out = []
        for place, text in zip(places, texts, strict=True):
            tree = parse(text)
            own = resolved(tree.canonical, place) if tree.canonical else None
            base = own if own and own.startswith(("http://", "https://")) else place
            out.append((base, *extract(tree, CRAWL), [x for x in (resolved(r, base) for r in tree.links) if x]))
        return tuple([r[i] for r in out] for i in range(4))

    rows = map_slices(pages.select("place", "html"), over, _typed("url string, title string, content string, links array<string>"))
    return rows.select(U.normalized(F.col("url")).alias("url"), "title", "content", "links")


def canonical(pages: DataFrame) -> DataFrame:
    """(page_id, canonical_url): absolute, null where the page names none."""

    def over(ids: list, urls: list, texts: list) -> tuple[list, ...]:
        return ids, [urljoin(u or "", c) if (c := parse(h).canonical) else None for u, h in zip(urls, texts, strict=True)]

    return map_slices(pages.select(F.col("page_id").cast("long"), "url", "html"), over, _typed("page_id long, canonical_url string"))
