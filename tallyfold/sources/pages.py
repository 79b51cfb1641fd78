"""Reading fields out of saved pages, with the standard library's parser inside Arrow batches.

Patterns suffice for links and plain text (``functions.web``); what depends on nesting is read here: the text of an element by tag
and class, the text beside an icon, the section below a heading, and the profile of a body."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript template".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Parts of an address that show a platform's or network's link, not a body's own site. Fixed values.
PLATFORMS = ("facebook.", "instagram.", "twitter.", "linkedin.", "youtube.", "tiktok.", "google.", "signup-hub.")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node | str]:
        stack: list = [self]
        while stack:
            n = stack.pop()
            yield n
            if isinstance(n, Node):
                stack.extend(reversed(n.children))

    def nodes(self) -> Iterator[Node]:
        return (n for n in self.walk() if isinstance(n, Node))

    def text(self, joiner: str = " ") -> str:
        return joiner.join(s for s in (x.strip() for x in self.walk() if isinstance(x, str)) if s)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag in HIDDEN:
            self.hidden += 1
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent
            if tag in HIDDEN:
                self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data):
        if not self.hidden:
            self.at.children.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def by_class(root: Node, tag: str | None, name: str | None) -> str | None:
    """The text of the first element with a tag and a class, if it has any."""
    for n in root.nodes():
        if (tag is None or n.tag == tag) and (name is None or name in n.attrs.get("class", "").split()):
            if t := n.text():
                return t
    return None


def beside_icon(root: Node, name: str) -> str | None:
    """The text of what surrounds the first element of a class."""
    for n in root.nodes():
        if name in n.attrs.get("class", "").split() and n.parent is not None:
            return n.parent.text() or None
    return None


def below_heading(root: Node, *words: str) -> str | None:
    """The text between a heading that contains one of the words and the next heading."""
    out: list[str] = []
    found = False
    for n in root.walk():
        if isinstance(n, Node) and n.tag in HEADINGS:
            if found:
                break
            found = any(w.lower() in n.text().lower() for w in words)
            skip = set(map(id, n.walk()))
        elif found and isinstance(n, str) and n.strip() and id(n) not in skip:
            out.append(n.strip())
    return " ".join(out) or None


def profile(root: Node) -> dict[str, str | None]:
    """A body's site, address, contact and number from its directory page."""
    anchors = [n.attrs.get("href", "").strip() for n in root.nodes() if n.tag == "a"]
    lines = [x for x in root.text("\n").split("\n") if x]
    text = " ".join(lines)
    place = re.search(r"([A-Za-z .'-]+),\s*([A-Z]{2})\s*(\d{5})", "\n".join(lines[lines.index("Address") + 1 :][:3])) if "Address" in lines else None
    meta = next((n.attrs.get("content", "").strip() for n in root.nodes() if n.tag == "meta" and (n.attrs.get("name") == "description" or n.attrs.get("property") == "og:description")), "")
    number = re.search(r"\b\d{2}-\d{7}\b", text)
    return {
        "website": next((a for a in anchors if a.startswith("http") and not any(p in a for p in PLATFORMS)), None),
        "email": next((a.split(":", 1)[1].split("?")[0] for a in anchors if a.lower().startswith("mailto:")), None),
        "ein": number[0] if number else None,
        "city": place[1].strip() if place else None,
        "state": place[2] if place else None,
        "zip": place[3] if place else None,
        "notes": meta[:300] or None,
    }


def read(pages: DataFrame, key: str, html: str, fields: tuple[str, ...], reader: Callable[[Node], dict[str, str | None]]) -> DataFrame:
    """(key, *fields) of every page; a page that lacks a field, or is null, has nulls."""
    kind = pages.schema[key].dataType.simpleString()
    picked = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [reader(tree(h)) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array([g.get(f) for g in got], pa.string()) for f in fields]], ["key", *fields])

    return picked.mapInArrow(run, ", ".join([f"key {kind}", *[f"{f} string" for f in fields]])).withColumnRenamed("key", key)


def next_offset(links: Column, current: Column) -> Column:
    """The smallest offset that a page's links name beyond the current one; null on the last page."""
    offsets = F.transform(links, lambda u: F.regexp_extract(u, r"[?&](?:s|offset|skip)=(\d+)", 1).try_cast("int"))
    return F.array_min(F.filter(offsets, lambda n: n > current))


def first_with_content(rows: DataFrame, key: str, urls: Column, content: Callable[[Column], Column]) -> DataFrame:
    """(key, url, content): of each row's addresses, in order, the first with content that is not empty."""
    tried = rows.select(key, F.posexplode(urls).alias("nth", "url")).where("url is not null").withColumn("content", content(F.col("url")))
    return tried.where("content <> ''").groupBy(key).agg(F.min_by("url", "nth").alias("url"), F.min_by("content", "nth").alias("content"))


def until_nothing_new(listed: DataFrame, page: str, key: str) -> DataFrame:
    """(key, page): what a crawl keeps that reads pages in order and stops at the first that names nothing new.

    A key is new on the first page that names it, so the stop is known from a count by page; no page is fetched one after
    the other, and nothing but these counts is ordered."""
    first = listed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(page).alias(page))
    fresh = listed.select(page).distinct().join(first.groupBy(page).agg(F.count("*").alias("fresh")), page, "left")
    stop = fresh.where("fresh is null").agg(F.min(page).alias("stop")).first()["stop"]
    return first.select(key, page) if stop is None else first.where(F.col(page) < stop).select(key, page)
