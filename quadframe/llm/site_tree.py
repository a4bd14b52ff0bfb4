"""Main text of web pages by site style trees.

The pages of a host are merged: elements with the same path of tags, classes and identifiers from the body down are one node of
the host's tree. A node with elements below has presentation styles, the sequences of child labels seen there; their entropy
over the node's pages is its presentation importance. A node with text of its own has content importance: one less the
mean entropy of its texts over pages. Composite importance is (1 - g ** styles) of the presentation and the rest of what
stands below (mean over text nodes, weighted by pages). All entropies have the number of pages as base, so a text that
all pages of a host share counts 0 and one that differs on each counts 1. As few pages prove little, importance is drawn to 1
with the weight of PRIOR pages. A branch is removed where its node and all nodes below are under LEAST. Pages of a host
with the same text count once, so an article that was copied many times is not taken for a part of the layout.

Counts alone can't tell an advert that rotates, or readers' comments, from an article, nor anything about a host of few pages.
So elements that HTML itself, or their class, identifier or role, names as menus, headers, footers, sidebars, notices, adverts,
forms or comments go first, and the text is taken from article elements, else from main, else from the body. What such names
don't tell is up to the tree.

Trees are counted by Spark from (host, node, kind, value) rows, each page's once, with partial sums; no host's pages meet in
a task. Null and empty pages have an empty text; null urls and such without a host are one host; very long pages are read
once from left to right; unclosed and misplaced tags end as browsers end them. Repeated rows are rows of their own; an
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .url_filter import host_of
from .work import Work

#: Weight of content against presentation for each style; importance under which a branch goes; pages' worth of prior importance 1.
STYLE, LEAST, PRIOR = 0.9, 0.2, 10
PAGE, STYLES, TEXTS, ABOVE = range(4)

# Elements of HTML by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
IN_HEAD = frozenset("base link meta title script style noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that don't end a block though they aren't part of it.
SILENT = frozenset("link meta script style template noscript".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: Element: what it ends, and where the search for that stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("html body table td th caption object template button article section main aside nav header footer form div".split())
#: Elements that are never an article's text.
NOISE = frozenset(
    "head nav footer aside form script style template noscript iframe svg canvas object embed audio video button select option textarea fieldset dialog menu title map noembed noframes search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tooltip status".split())
#: Words of classes and identifiers that name such parts, and words beside them that say otherwise.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adsbygoogle adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr ccpa notice notices notification
    notifications alert alerts newsletter subscribe subscription signup signin login popup popups modal overlay lightbox paywall menu menus nav navbar navigation navi topbar breadcrumb breadcrumbs pagination pager
    sidebar sidebars widget widgets aside footer comment comments commentlist disqus respond replies share sharing social related recommended recommendations copyright searchbox skiplink toolbar masthead""".split()
)
OUTSIDE = frozenset("header headers".split())
UNSAID = frozenset("no non not without with has have is open opened closed free enabled disabled off on hide hidden show layout left right body wrapper page".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_TAG = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _named(value: str) -> tuple[bool, bool]:
    """Whether words of a class or identifier name a part to leave out; whether they do so outside an article only."""
    always = outside = False
    for token in value.split():
        words = {w.lower() for w in _WORD.findall(token)}
        if not words & UNSAID:
            always, outside = always or bool(words & NAMES), outside or bool(words & OUTSIDE)
    return always, outside


class Page:
    """Elements of a page in order, parents first, and its text runs; a run of None ends a block."""

    def __init__(self, text: str):
        self.tags, self.parents, self.labels, self.noise, self.outside, self.main = ["#"], [-1], [""], [False], [False], [False]
        self.runs: list[tuple[int, str | None]] = []
        self.stack = [0]
        self._read(text)

    def _read(self, text: str) -> None:
        at, n, raw_end = 0, len(text), {}
        while at < n:
            lt = text.find("<", at)
            if lt < 0:
                self._text(text[at:])
                return
            if lt > at:
                self._text(text[at:lt])
            m = _TAG.match(text, lt + 1)
            if m is None:
                if text.startswith("<!--", lt):
                    end = lt + 4 if text.startswith("<!-->", lt) else lt + 5 if text.startswith("<!--->", lt) else text.find("-->", lt + 4) + 2
                    at = end + 1 if end > lt + 1 else n
                elif text[lt + 1 : lt + 2] in ("!", "?", "/"):
                    end = text.find(">", lt)
                    at = end + 1 if end >= 0 else n
                else:
                    self._text("<")
                    at = lt + 1
                continue
            tag, at, attributes = m[1].lower(), m.end(), {}
            while a := _ATTRIBUTE.match(text, at):
                attributes.setdefault(a[1].lower(), next((v for v in a.groups()[1:] if v is not None), ""))
                at = a.end()
            end = text.find(">", at)
            if end < 0:
                return
            at = end + 1
            if text[lt + 1] == "/":
                self._close(tag)
                continue
            self._open(tag, attributes)
            if tag in RAW:
                close = None
                if raw_end.get(tag, 0) is not None:
                    close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
                raw_end[tag] = close and close.start()
                at = close.start() if close else n

    def _text(self, raw: str) -> None:
        here = self.stack[-1]
        if self.tags[here] == "head" and raw.strip():
            self.stack.pop()
            here = self.stack[-1]
        self.runs.append((here, html.unescape(raw) if "&" in raw else raw))

    def _cut(self, place: int) -> None:
        del self.stack[place:]
        self.runs.append((self.stack[-1], None))

    def _find(self, tags, until) -> int | None:
        for place in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[place]]
            if tag in tags:
                return place
            if tag in until:
                return None
        return None

    def _open(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body") and tag in self.tags:
            return
        head = self._find(("head",), ())
        if head is not None and tag not in IN_HEAD:
            self._cut(head)
        if tag in CLOSES_P and (p := self._find(("p",), SCOPE)) is not None:
            self._cut(p)
        if tag in ENDS:
            place = self._find(*ENDS[tag])
            while place is not None:
                self._cut(place)
                place = self._find(*ENDS[tag])
        name = " ".join((attributes.get("class", ""), attributes.get("id", "")))
        always, outside = _named(name) if name != " " else (False, False)
        role, top = attributes.get("role", "").strip().lower(), tag in ("html", "body")
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.labels.append(tag + "".join(sorted("." + re.sub(r"\d+", "", c) for c in name.split())))
        self.noise.append(not top and (tag in NOISE or always or hidden or role in ROLES))
        self.outside.append(not top and (tag == "header" or outside))
        self.main.append(tag == "main" or role == "main")
        if tag == "br":
            self.runs.append((self.stack[-1], " "))
        elif tag not in INLINE and tag not in SILENT:
            self.runs.append((self.stack[-1], None))
        if tag not in VOID:
            self.stack.append(len(self.tags) - 1)

    def _close(self, tag: str) -> None:
        if tag == "br":
            self.runs.append((self.stack[-1], " "))
            return
        inline = tag in INLINE
        for place in range(len(self.stack) - 1, 0, -1):
            here = self.tags[self.stack[place]]
            if here == tag:
                del self.stack[place:]
                break
            if inline and here not in INLINE:
                break
        if not inline and tag not in SILENT:
            self.runs.append((self.stack[-1], None))

    def kept(self) -> list[bool]:
        """By element: whether names leave its text in."""
        tags, parents, n = self.tags, self.parents, len(self.tags)
        for strict in (True, False):  # at last, containers with such names may hold the article itself
            for kind in (lambda i: tags[i] == "article", lambda i: self.main[i]):
                out, inside = [False] * n, [False] * n
                for i in range(1, n):
                    p = parents[i]
                    inside[i] = inside[p] or out[p]
                    if out[p]:
                        out[i] = not self.noise[i]
                    elif not inside[i] and kind(i) and not self.noise[i]:
                        out[i] = not (strict and self._under(i))
                if any(out):
                    return out
        out = [True] * n
        for i in range(1, n):
            out[i] = out[parents[i]] and not self.noise[i] and not self.outside[i]
        return out

    def _under(self, i: int) -> bool:
        """Whether an element that is left out stands above."""
        i = self.parents[i]
        while i > 0 and not (self.noise[i] or self.outside[i]):
            i = self.parents[i]
        return i > 0

    def nodes(self) -> list[int]:
        """By element: its node in the style tree; inline elements belong to what they stand in."""
        import xxhash

        paths, out = [""], [0]
        for i in range(1, len(self.tags)):
            p, tag = self.parents[i], self.tags[i]
            if tag in INLINE:
                paths.append(paths[p])
                out.append(out[p])
            else:
                paths.append("" if tag in ("html", "body") else f"{paths[p]}/{self.labels[i]}"[-4000:])
                out.append(xxhash.xxh3_64_intdigest(paths[i]) - (1 << 63))
        return out

    def blocks(self, kept: list[bool], nodes: list[int] | None = None, drop: frozenset = frozenset()) -> list[tuple[int, str]]:
        """(element, text) of each block, in order."""
        if drop:
            gone = [False] * len(kept)
            for i in range(1, len(kept)):  # what text is taken from stays
                p = self.parents[i]
                gone[i] = kept[p] and (gone[p] or nodes[i] in drop)
            kept = [k and not g for k, g in zip(kept, gone)]
        out, pieces, first = [], [], 0
        for i, run in [*self.runs, (0, None)]:
            if run is None:
                if pieces and (text := " ".join("".join(pieces).split())):
                    out.append((first, text))
                pieces = []
            elif kept[i]:
                first = first if pieces else i
                pieces.append(run)
        return out


def features(page: Page) -> tuple[str, list[tuple[int, int, int]]]:
    """The text that names leave in, and distinct (node, kind, value) of what stands in it."""
    import xxhash

    of = lambda s: xxhash.xxh3_64_intdigest(s) - (1 << 63)
    kept, nodes = page.kept(), page.nodes()
    found, below = set(), {}
    for i in range(1, len(page.tags)):
        p = page.parents[i]
        if kept[i] and page.tags[i] not in INLINE:
            found.add((nodes[i], PAGE, 0))
            while page.tags[p] in INLINE:
                p = page.parents[p]
            if p > 0 and kept[p]:
                below.setdefault(p, []).append(page.labels[i])
            while p > 0 and kept[p]:
                if nodes[p] != nodes[i]:
                    found.add((nodes[i], ABOVE, nodes[p]))
                p = page.parents[p]
    found |= {(nodes[p], STYLES, of(" ".join(labels))) for p, labels in below.items()}
    blocks = page.blocks(kept)
    found |= {(nodes[i], TEXTS, of(text)) for i, text in blocks}
    found |= {(nodes[i], PAGE, 0) for i, _ in blocks}
    return " ".join(t for _, t in blocks), sorted(found)


def seen(pages: DataFrame) -> DataFrame:
    """(host, text, parts) of each different text of a host; text is a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        entry = pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())])
        for batch in batches:
            texts, parts = [], []
            for x in batch.column(1).to_pylist():
                text, found = features(Page(x or ""))
                texts.append(xxhash.xxh3_128_hexdigest(text))
                parts.append([{"node": a, "kind": b, "value": c} for a, b, c in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts), pa.array(parts, pa.list_(entry))], ["host", "text", "parts"])

    each = pages.select("host", "html").mapInArrow(run, "host string, text string, parts array<struct<node:long,kind:int,value:long>>")
    return each.groupBy("host", "text").agg(F.min("parts").alias("parts"))


def trees(pages: DataFrame, work: Work) -> DataFrame:
    """(host, node, pages, importance, noisy) of the style trees of pages (host, html)."""
    counts = seen(pages).select("host", F.explode("parts").alias("x")).groupBy("host", "x.node", "x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))
    counts = work.save(counts, "counts")
    own = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    n, log_n = F.col("n"), F.log(F.col("n").cast("double"))
    nodes = counts.groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == PAGE, n)).alias("pages"), own(STYLES, n).alias("all_styles"), own(STYLES, n * log_n).alias("styles_log"), own(STYLES, F.lit(1)).alias("styles"), own(TEXTS, log_n).alias("texts_log"), own(TEXTS, F.lit(1)).alias("texts")
    )
    base = F.when(F.col("pages") > 1, F.log(F.col("pages").cast("double")))
    shown = F.coalesce(F.least(F.lit(1.0), (F.log(F.col("all_styles").cast("double")) - F.col("styles_log") / F.col("all_styles")) / base), F.lit(1.0))
    said = F.when(F.col("texts") > 0, F.coalesce(1 - F.col("texts_log") / F.col("texts") / base, F.lit(1.0)))
    nodes = work.save(nodes.select("host", "node", "pages", F.coalesce("styles", F.lit(0)).alias("styles"), shown.alias("presentation"), said.alias("content")), "nodes")
    pairs = counts.filter(F.col("kind") == ABOVE).select("host", "node", F.col("value").alias("above"), "n")
    inner = pairs.join(nodes.filter("content is not null").select("host", "node", "content"), ["host", "node"])
    inner = inner.groupBy("host", F.col("above").alias("node")).agg((F.sum(F.col("n") * F.col("content")) / F.sum("n")).alias("inner"))
    own_or_inner = F.coalesce((F.col("content") + F.col("inner")) / 2, "content", "inner", F.lit(1.0))
    weight = F.pow(F.lit(STYLE), F.col("styles"))
    drawn = lambda x: (F.col("pages") * x + PRIOR) / (F.col("pages") + PRIOR)
    rated = nodes.join(inner, ["host", "node"], "left").select("host", "node", "pages", drawn(F.when(F.col("styles") > 0, (1 - weight) * F.col("presentation") + weight * own_or_inner).otherwise(own_or_inner)).alias("importance"))
    rated = work.save(rated, "rated")
    most = pairs.join(rated.select("host", "node", "importance"), ["host", "node"]).groupBy("host", F.col("above").alias("node")).agg(F.max("importance").alias("below"))
    return rated.join(most, ["host", "node"], "left").select("host", "node", "pages", "importance", (F.greatest("importance", "below") < LEAST).alias("noisy"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for each row of pages."""
    work = Work(pages.sparkSession, "site_tree")
    host: Column = F.coalesce(host_of(F.col(f"`{url}`")), F.lit(""))
    picked = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("html"), host.alias("host"))
    noisy = trees(picked, work).filter("noisy").groupBy("host").agg(F.collect_set("node").alias("drop"))
    noisy = work.save(noisy, "noisy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = Page(x or "")
                texts.append(" ".join(t for _, t in page.blocks(page.kept(), page.nodes() if drop else None, frozenset(drop or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    out = picked.join(noisy, "host", "left").select("id", "url", "html", "drop").mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": key, "url": url, "text": "text"})
