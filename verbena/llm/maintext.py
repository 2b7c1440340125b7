"""Main texts of web pages by a site style tree.

Pages of one host are merged into one tree: elements whose path of names, classes and ids is the same are one node. A node's presentation importance
is the entropy of the ways in which pages lay it out; its content importance is one less the mean entropy of the texts that it holds,
so texts that all pages share weigh nothing and texts of one page weigh all. In a page an element's importance combines its node's
with that of what is in it, and branches of little importance go. What elements say of themselves (nav, footer, a class "sidebar", role="search")
counts before: such branches have no importance, and never become nodes.

Nodes are 64-bit hashes of host and path, so a host's tree is rows, never one object, and a host of a third of all pages is spread by node. Texts
and layouts are counted per node with partial sums before they are shuffled; a page that has copies counts once.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from .common import dealt_join, free_name, release, ship, written
from .pagetree import BLOCK, HEADINGS, Element, blocks, parse

#: Branches of less importance go; a node is weighed if so many pages of its host have it; share of a node's own layout.
LEAST, PAGES, GAMMA = 0.25, 8, 0.9
#: A block outside of any article with so many links that hold so much of its text is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.6
#: Elements around a page's article that are no reason to drop it: forms and menus that are never closed.
AROUND = frozenset("form nav header menu".split())


_NUMBER = re.compile(r"\d+")


def _signed(n: int) -> int:
    return n - 2**64 if n >= 2**63 else n


def _ordered(root: Element) -> list[tuple[Element, Element | None, bool]]:
    """Elements, parents first, with the parent and whether an article holds them."""
    out: list[tuple[Element, Element | None, bool]] = [(root, None, False)]
    for e, _, inside in out:
        out.extend((k, e, inside or e.main) for k in e.kids if not isinstance(k, str))
    return out


class Page:
    """A page's elements, parents first, and what they hold."""

    def __init__(self, html: str, seed: int) -> None:
        self.root = parse(html, seed)
        self.order = _ordered(self.root)

    @functools.cached_property
    def links(self) -> dict[int, tuple[int, int, int]]:
        """By element: letters, letters in links, links."""
        out: dict[int, tuple[int, int, int]] = {}
        for e, _, _ in reversed(self.order):
            parts = [out[id(k)] for k in e.kids if not isinstance(k, str)]
            letters = sum(len("".join(k.split())) for k in e.kids if isinstance(k, str)) + sum(p[0] for p in parts)
            link = e.name == "a"
            out[id(e)] = (letters, letters if link else sum(p[1] for p in parts), link + sum(p[2] for p in parts))
        return out

    def noise(self, e: Element, inside: bool) -> bool:
        """A header goes but for an article's own with a heading; a form goes unless an article is in it."""
        if e.name == "header":
            return not (inside and any(x.name in HEADINGS for x in _below(e)))
        return e.noise and not (e.name == "form" and any(x.main for x in _below(e)))

    def nodes(self) -> Iterator[tuple[int, str, str]]:
        """node, layout, own text of each block outside of furniture; inline elements are part of the block around them."""
        dropped: set[int] = set()
        for e, parent, inside in self.order:
            if (parent is not None and id(parent) in dropped) or self.noise(e, inside):
                dropped.add(id(e))
            elif e.name in BLOCK:
                text, layout, todo = [], [], list(reversed(e.kids))
                while todo:
                    k = todo.pop()
                    if isinstance(k, str):
                        text.append(k)
                    elif k.name in BLOCK:
                        if layout[-1:] != [k.sign]:
                            layout.append(k.sign)
                    elif not k.noise:
                        todo.extend(reversed(k.kids))
                own = " ".join("".join(text).split())
                yield e.node, "\n".join(["#"] * bool(own) + layout), own

    def importance(self, weights: dict[int, tuple[float, int, float | None]]) -> dict[int, float]:
        """By element; 1 for those whose node is not weighed. weights: presentation, number of layouts, content (null without texts) by node."""
        out: dict[int, float] = {}
        below: dict[int, list[float]] = {}
        for e, parent, _ in reversed(self.order):
            parts = below.get(id(e), [])
            known = weights.get(_signed(e.node)) if e.name in BLOCK else None
            if known is None:
                value = sum(parts) / len(parts) if parts and e.name not in BLOCK else 1.0
            else:
                presentation, layouts, content = known
                inner = [*parts, *([content] if content is not None else [])]
                share = GAMMA**layouts
                value = (1 - share) * presentation + share * (sum(inner) / len(inner) if inner else 1.0)
            out[id(e)] = value
            if parent is not None and e.name in BLOCK and not e.noise:
                below.setdefault(id(parent), []).append(value)
        return out

    def text(self, weights: dict[int, tuple[float, int, float | None]]) -> str:
        importance = self.importance(weights) if weights else {}
        gone: set[int] = set()
        mains: list[Element] = []
        shut: set[int] = set()  # below what no article may be in, or in an article
        for e, parent, inside in self.order:
            lost = parent is not None and id(parent) in shut
            noise = self.noise(e, inside)
            low = e.name in BLOCK and e.name not in HEADINGS and e.name not in ("html", "body") and not e.main and importance.get(id(e), 1.0) < LEAST
            if noise or low:
                gone.add(id(e))
            article = e.main and not noise and any(isinstance(k, str) and not k.isspace() for x in _below(e) for k in x.kids)
            if lost or (noise and e.name not in AROUND) or low or article:
                shut.add(id(e))
                if article and not lost:
                    mains.append(e)
        if mains:
            parts = [b for m in mains for b in blocks(m, lambda e: id(e) not in gone)]
        else:
            menu = lambda e, x: e.name in BLOCK and e.name not in ("html", "body", "main", "p") and x[2] >= MENU_LINKS and x[1] >= MENU_SHARE * x[0]
            parts = blocks(self.root, lambda e: id(e) not in gone and not menu(e, self.links[id(e)]))
        return "\n\n".join(parts)


def _below(e: Element) -> Iterator[Element]:
    todo = [e]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(k for k in x.kids if not isinstance(k, str))


def _seed(host: str) -> int:
    return xxhash.xxh64_intdigest(host)


def _nodes(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, host, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            layouts: dict[int, set[str]] = {}
            texts: set[tuple[int, int]] = set()
            for node, layout, own in Page(html, _seed(host)).nodes():
                layouts.setdefault(node, set()).add(layout)
                if own:
                    texts.add((node, xxhash.xxh64_intdigest(_NUMBER.sub("0", own.lower()))))
            rows.append({
                "key": key, "nodes": [{"node": _signed(n), "layout": _signed(xxhash.xxh64_intdigest("\0".join(sorted(s))))} for n, s in layouts.items()],
                "texts": [{"node": _signed(n), "text": _signed(t)} for n, t in texts],
            })
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def node_weights(sites: DataFrame) -> DataFrame:
    """node, n, presentation, layouts, content of each node that enough pages have; sites has a row for each page: its nodes with layouts, and texts."""
    laid = sites.select(F.explode("nodes").alias("x")).groupBy("x.node", "x.layout").agg(F.count("*").alias("c"))
    nodes = laid.groupBy("node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"), F.count("*").cast("int").alias("layouts")).where(F.col("n") >= PAGES)
    held = sites.select(F.explode("texts").alias("x")).groupBy("x.node", "x.text").agg(F.count("*").alias("c")).groupBy("node").agg(F.avg(F.log2("c")).alias("h"))
    most = F.log2("n")
    return nodes.join(held, "node", "left").select("node", "n", (1 - F.col("s") / F.col("n") / most).alias("presentation"), "layouts", (1 - F.col("h") / most).alias("content"))


@F.pandas_udf(StringType())
def _texts(html: pd.Series, host: pd.Series, nodes: pd.Series, presentation: pd.Series, layouts: pd.Series, content: pd.Series) -> pd.Series:
    out = []
    for h, s, *w in zip(html, host, nodes, presentation, layouts, content, strict=True):
        weights = {} if w[0] is None else {int(n): (p, int(k), None if c is None or c != c else c) for n, p, k, c in zip(*w, strict=True)}
        out.append(Page(h, _seed(s)).text(weights) if h else "")
    return pd.Series(out, dtype=object)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_texts(pages: DataFrame, url: str = "url", html: str = "html", out: str = "main_text") -> DataFrame:
    """pages with a column `out`: the main text of each page, its blocks joined by empty lines.

    Nodes that fewer than PAGES different pages of a host have are not weighed: such pages go by what elements say of themselves. Of a page with articles
    only these count; else all that is left. White space in a block is one space. Null and empty pages have an empty text; a null url is a
    host of its own; repeated rows and copies count once for the tree and have one text each; texts may be of any length and depth; an empty table stays empty;
    columns may have any names.
    """
    spark = pages.sparkSession
    ship(spark)
    host, key, found = (free_name(pages, w) for w in ("host", "key", "weights"))
    page = F.coalesce(html, F.lit(""))
    hosted = pages.withColumns({host: host_of(F.col(url)), key: F.unhex(F.md5(F.concat(host_of(F.col(url)), F.lit("\n"), page).cast("binary")))})
    fields = "key binary, nodes array<struct<node:bigint,layout:bigint>>, texts array<struct<node:bigint,text:bigint>>"
    schema = to_arrow_schema(StructType.fromDDL(fields))
    read = hosted.where(page != "").select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(html).alias("html"))
    sites = written(read.mapInArrow(lambda batches: _nodes(batches, schema), fields).dropDuplicates(["key"]), "sites")
    weights = written(node_weights(sites), "node-weights")
    own = sites.select("key", F.explode("nodes.node").alias("node"))
    met = dealt_join(own, weights.drop("n"), "node", sites.count(), counts=weights.select("node", "n"))
    lists = met.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("node", "presentation", "layouts", "content")).alias(found))
    lists = written(lists, "page-weights")
    release(sites, weights)
    copies = hosted.groupBy(key).agg(F.count("*").alias("n"))
    rows = dealt_join(hosted, lists, key, pages.count(), "left", counts=copies)
    text = _texts(F.col(html), F.col(host), *(F.col(found)[c] for c in ("node", "presentation", "layouts", "content")))
    return rows.select(*pages.columns, text.alias(out))
