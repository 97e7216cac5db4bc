"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: equal paths of elements (tag with class and id) are one style node.
A node's content importance is the entropy of the texts that stand directly in it over the host's pages, its
presentation importance that of the sequences of its children; both are over their greatest possible value, and the greater is
the node's own. Names are a prior that is multiplied with it: an element that HTML itself sets apart (navigation, footers, asides,
forms, page headers) has none, one whose class, role or id is a whole word of decoration a tenth. A branch is as important as its most important
node. What is less important than ``threshold`` on at least ``min_pages`` pages goes from every page; a node met on fewer counts by
its name alone. Equal pages of a host count as one page in all of this.

The page's article (or main element, or main-like division, or else the whole page without blocks that are mostly links) is its text. Inside an
article importance decides as well: a branch that the host repeats goes, while headings stay, and so does everything where nothing else
would be left. An element that holds the article is never decoration, headers inside an article keep
their headings, and reader comments are no articles. Where names alone would leave nothing, the most important blocks are the text.

Node counts are grouped before they are shuffled, so a host of any size spreads; only nodes of pages that have copies
are first told apart by page, and pages themselves are not shuffled for it. Every node brings the path above it, so
a branch's importance is one grouped maximum. A page meets the short list of its host's topmost removed nodes in a join that Spark broadcasts
by measured size or splits; hosts with more than ``MOST_REMOVED`` of them meet page by page, by the nodes that the page has.

Cases: null or empty html gives an empty text; a page without a host takes part in no tree; unclosed and stray tags
are mended by nesting; repeated rows get a row each; other columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Element names by their role in HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub "
    "sup time tt u var wbr br img".split())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSED_BY_SAME = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot"}
NOT_IN_P = set(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
DECORATION = {
    "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "input", "fieldset", "svg", "canvas", "object", "audio",
    "video", "map", "head", "applet", "datalist", "progress", "meter",
}
#: Words of class, id and role attributes that name decoration.
DECORATION_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promoted promotion sidebar rail "
    "widget widgets menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer foot masthead topbar header "
    "comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login signin register form search share sharing social follow related recommended recommendations "
    "teaser outbrain taboola copyright legal disclaimer skip tags tagcloud banner complementary contentinfo".split())
ARTICLE_WORDS = {"article", "main", "content", "post", "entry", "story"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion"}
#: Words that only say where or what kind of box, beside a word of decoration in one name.
QUALIFIERS = set("site page top bottom left right box block bar wrap wrapper list section area container primary secondary global mobile slot unit".split())
HEADER_WORDS = {"header", "masthead", "topbar", "banner"}

#: Importance of elements by their names alone, as a factor.
PLAIN, NAMED, SET_APART = 1.0, 0.1, 0.0
#: Removed nodes of a host that go to each of its pages as a list.
MOST_REMOVED = 2000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.DOTALL)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_PARTS = re.compile(r"[^a-z0-9]+")


def named_decoration(value: str, words: set[str] = DECORATION_WORDS) -> bool:
    """Whether a class, id or role attribute has a whole name that says decoration; parts of other names say nothing."""
    for name in value.split():
        parts = [p for p in _PARTS.split(name) if p]
        if any(p in words for p in parts) and all(p in words or p in QUALIFIERS or p.isdigit() for p in parts):
            return True
    return False


@dataclass(slots=True)
class Element:
    """An open element: its tag, style node, path of style nodes, prior importance, and the elements it stands in."""

    tag: str
    path: tuple[int, ...]
    prior: float
    above: Element | None
    article: bool = False
    main: bool = False

    def chain(self):
        e = self
        while e is not None:
            yield e
            e = e.above


@dataclass(slots=True)
class Block:
    text: str
    element: Element
    links: float  # share of characters in links


class Page:
    """Blocks of a page in order, each with the element it stands in."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.children: dict[tuple[int, ...], list[str]] = defaultdict(list)
        self.articles: list[Element] = []
        self._read(html)
        self._spare()

    def _read(self, html: str) -> None:
        stack, buffer, link, linked, at, end = [Element("", (hash_of(""),), PLAIN, None)], [], 0, 0, 0, len(html)

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join(entities.unescape("".join(buffer)).split())
                if text:
                    self.blocks.append(Block(text, stack[-1], min(1.0, linked / len(text))))
                buffer.clear()
            linked = 0

        while at < end:
            m = _TOKEN.search(html, at)
            stop = m.start() if m else end
            if stop > at:
                buffer.append(html[at:stop])
                if link:
                    linked += stop - at
            if not m:
                break
            token, at = m.group(), m.end()
            if token[1] in "!?":
                if token.startswith("<![CDATA["):
                    buffer.append(token[9:].removesuffix("]]>"))
                continue
            closing, name = token[1] == "/", _NAME.match(token).group(1).lower()
            if name in INLINE:
                if name == "a":
                    link = 0 if closing else 1
                elif name in ("br", "wbr", "img"):
                    buffer.append(" " if name == "br" else "")
                continue
            if closing:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
                flush()
                if depth:
                    del stack[depth:]
                continue
            if name in RAW:
                close = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.IGNORECASE).search(html, at)
                if name not in ("noscript", "template") or close:
                    at = close.end() if close else end
                continue
            flush()
            if name in VOID:
                continue
            if name in NOT_IN_P and any(e.tag == "p" for e in stack):
                del stack[next(i for i, e in enumerate(stack) if e.tag == "p"):]
            if name in CLOSED_BY_SAME and stack[-1].tag == name:
                stack.pop()
            stack.append(self._element(name, token, stack[-1]))
        flush()

    def _element(self, name: str, token: str, above: Element) -> Element:
        found = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(token)} if "=" in token else {}
        inside = any(e.article for e in above.chain())
        words = DECORATION_WORDS - HEADER_WORDS if inside else DECORATION_WORDS
        if name in ("article", "main"):
            words = COMMENT_WORDS
        values = [v for k, v in found.items() if k != "itemprop"]
        prior = PLAIN
        if name in DECORATION or name == "header" and not inside:
            prior = SET_APART
        elif name not in ("html", "body") and any(named_decoration(v, words) for v in values):
            prior = SET_APART if any(named_decoration(v, COMMENT_WORDS) for v in values) else NAMED
        own_id = found.get("id", "")
        label = " ".join([name, found.get("class", ""), own_id if not any(c.isdigit() for c in own_id) else ""])
        self.children[above.path].append(label)
        names = {w for v in found.values() for w in _WORDS.findall(v)}
        element = Element(name, (*above.path, hash_of(f"{above.path[-1]}>{label}")), prior, above)
        element.article = name == "article" and prior > 0
        element.main = prior > 0 and (name == "main" or found.get("role") == "main" or name in ("div", "section") and bool(names & ARTICLE_WORDS))
        if element.article or name == "main" and prior > 0:
            self.articles.append(element)
        return element

    def _spare(self) -> None:
        """What holds the article is no decoration; articles inside decoration count only where no other is."""
        outer = [a for a in self.articles if not any(e.prior < PLAIN for e in a.above.chain())]
        if outer:
            return
        for a in self.articles:
            if not any(e.tag == "article" and e.prior == SET_APART or e.prior == SET_APART and e.tag in ("nav", "aside", "footer") for e in a.above.chain()):
                for e in a.above.chain():
                    if e.tag == "form" or e.prior == NAMED:
                        e.prior = PLAIN

    @staticmethod
    def prior(block: Block) -> float:
        return min(e.prior for e in block.element.chain())

    def text(self, removed: set[int], threshold: float = 0.2) -> str:
        """The main text, without what its prior or its host's ``removed`` style nodes leave unimportant."""
        priors = [self.prior(b) for b in self.blocks]
        kept = [b for b, p in zip(self.blocks, priors) if p >= threshold]
        if not kept:  # names alone say that all is decoration: the best of it, but for what HTML or comments set apart
            kept = [b for b, p in zip(self.blocks, priors) if p > SET_APART and p == max(priors)]
        own = lambda b: not removed.intersection(b.element.path)
        inner = [b for b in kept if any(e.article for e in b.element.chain())]
        if inner:
            if any(own(b) and b.element.tag not in HEADINGS for b in inner):
                inner = [b for b in inner if own(b) or b.element.tag in HEADINGS]
            return "\n".join(b.text for b in inner)
        kept = [b for b in kept if own(b)]
        inner = [b for b in kept if any(e.main for e in b.element.chain())]
        return "\n".join(b.text for b in inner or kept if inner or b.links < 0.5)

    def nodes(self) -> list[tuple[bytes, float, int, int]]:
        """(path, prior, content hash, presentation hash) of every style node met with text or children."""
        own, prior = defaultdict(list), {}
        for b in self.blocks:
            own[b.element.path].append(b.text)
            for e in b.element.chain():
                if e.above is not None:
                    prior[e.path] = e.prior
        return [
            (path[1:], p, hash_of("\n".join(own.get(path, ()))), hash_of("\n".join(dict.fromkeys(self.children.get(path, ())))))
            for path, p in prior.items()]


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def host(url: Column) -> Column:
    """The lower-case host of a URL; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url.cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def importances(pages: DataFrame, min_pages: int = 8) -> DataFrame:
    """``host, node, above, m, importance``: every style node, how many pages have it, and the importance of its branch.

    ``above`` is the node it stands in. A node of fewer than ``min_pages`` pages has the importance of its name.
    """
    rows = pages.select(host(F.col("url")).alias("host"), common.text_or_empty("html").alias("html")).filter("host is not null")
    rows = rows.withColumn("page", F.xxhash64("host", "html"))
    copied = common.stage(rows.groupBy("page").agg(F.count("*").alias("n")).filter("n > 1").select("page"), "site-copies")
    bitmap = common.members(copied, "page")

    def work(slices):
        for rows in slices:
            copy = common.is_member(bitmap, np.array(rows["page"], np.int64))
            pages = zip(rows["host"], rows["page"], copy, rows["html"])
            found = [(h, page if c else None, *n) for h, page, c, html in pages for n in Page(html).nodes()]
            yield {k: [f[i] for f in found] for i, k in enumerate(("host", "page", "path", "prior", "content", "shape"))}

    nodes = common.map_batches(
        rows, {"host": pa.string(), "page": pa.int64(), "path": pa.list_(pa.int64()), "prior": pa.float64(), "content": pa.int64(), "shape": pa.int64()},
        "host string, page long, path array<long>, prior double, content long, shape long", work)
    kinds = nodes.select("host", "page", "path", "prior", F.posexplode(F.array("content", "shape")).alias("kind", "value"))
    # pages without copies have no page here and are counted at once; of the others each page counts once
    value = ("host", "path", "prior", "kind", "value")
    counts = kinds.groupBy(*value, "page").agg(F.count("*").alias("n"))
    counts = counts.groupBy(*value).agg(F.sum(F.when(F.col("page").isNull(), F.col("n")).otherwise(1)).alias("n"))
    # a node inside what only some pages need of a decoration's name has two priors: the greater counts
    entropy = counts.groupBy("host", "path", "kind").agg(
        F.max("prior").alias("prior"), F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    weight = F.when(F.col("m") > 1, (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).otherwise(1.0)
    own = entropy.groupBy("host", "path").agg(F.max("prior").alias("prior"), F.max(weight).alias("weight"), F.max("m").alias("m"))
    own = own.withColumn("own", F.col("prior") * F.when(F.col("m") < min_pages, 1.0).otherwise(F.col("weight")))
    # a branch is as important as its most important node: each node tells all nodes above it
    told = own.select(
        "host", F.col("own"), "m", F.posexplode("path").alias("depth", "node"), F.size("path").alias("size"),
        F.when(F.size("path") > 1, F.col("path")[F.size("path") - 2]).alias("above"))
    self_ = F.col("depth") == F.col("size") - 1
    return told.groupBy("host", "node").agg(
        F.max(F.when(self_, F.col("above"))).alias("above"), F.max(F.when(self_, F.col("m"))).alias("m"), F.max("own").alias("importance"))


def decoration(pages: DataFrame, threshold: float = 0.2, min_pages: int = 8) -> DataFrame:
    """``host, node``: the topmost style nodes whose branch is unimportant on enough pages."""
    low = common.stage(
        importances(pages, min_pages).filter((F.col("m") >= min_pages) & (F.col("importance") < threshold)).select("host", "node", "above"), "site-low")
    inner = low.select(F.col("host").alias("_host"), F.col("node").alias("_node"))
    return low.join(inner, (F.col("host") == F.col("_host")) & (F.col("above") == F.col("_node")), "left_anti").select("host", "node")


def extract(pages: DataFrame, threshold: float = 0.2, min_pages: int = 8) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    removed = common.stage(decoration(pages, threshold, min_pages), "site-decoration")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_or_empty("html").alias("html"))
    rows = rows.withColumn("host", host(F.col("url")))
    counts = common.stage(removed.groupBy("host").agg(F.count("*").alias("n")), "site-counts")
    lists = removed.join(counts.filter(F.col("n") <= MOST_REMOVED), "host", "left_semi").groupBy("host").agg(F.collect_list("node").alias("removed"))
    met = rows.join(lists.withColumnRenamed("host", "known"), F.col("host") == F.col("known"), "left").drop("known")
    wide = counts.filter(F.col("n") > MOST_REMOVED).select(F.col("host").alias("wide"))
    if not wide.isEmpty():
        met = _by_page(met, removed, wide)

    def work(slices):
        for rows in slices:
            texts = [Page(h).text(set(r or ()), threshold) for h, r in zip(rows["html"], rows["removed"])]
            yield {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return common.map_batches(
        met.select("page_id", "url", "html", "removed"), {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()},
        "page_id long, url string, text string, n_chars long", work)


def _by_page(rows: DataFrame, removed: DataFrame, wide: DataFrame) -> DataFrame:
    """``rows`` with the removed nodes that a page itself has, for pages of hosts with very many; other pages as they are."""
    keyed = rows.withColumn("page", F.xxhash64("host", "html"))
    own = keyed.join(wide, F.col("host") == F.col("wide"), "left_semi").select("host", "page", "html")

    def work(slices):
        for rows in slices:
            nodes = [sorted({n for path, *_ in Page(h).nodes() for n in path}) for h in rows["html"]]
            yield {"host": rows["host"], "page": rows["page"], "nodes": nodes}

    nodes = common.map_batches(
        own, {"host": pa.string(), "page": pa.int64(), "nodes": pa.list_(pa.int64())}, "host string, page long, nodes array<long>", work)
    met = nodes.select("host", "page", F.explode("nodes").alias("node")).distinct().join(removed, ["host", "node"])
    found = met.groupBy(F.col("page").alias("_page")).agg(F.collect_list("node").alias("own"))  # at most the nodes of a page
    return keyed.join(found, F.col("page") == F.col("_page"), "left").withColumn("removed", F.coalesce("own", "removed")).drop("page", "_page", "own")

