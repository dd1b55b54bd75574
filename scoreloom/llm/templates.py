"""Main text of web pages: site template removal, then the blocks of the article.

Pages are parsed into elements. Every element subtree with text is hashed (tag, class, id, white-space-normal text, children)
and counted by host in Spark, once for each different article text, so copies of one article don't count as a
template. A subtree that recurs with at least PAGES articles and at least SHARE of the host's articles is part of the site's
template and is deleted wherever it stands on that host. So a host has at most (subtrees of a page) / SHARE of them.

From what is left go the elements that are boilerplate by their tag, role or labels (words of class and id). The
outermost main and article elements are the main text, or the body where there are none. A block element begins and ends a
block; white space inside a block becomes one space; blocks are joined by a line feed.

Cases. Null and empty html: empty text. Null urls and urls without host: one host of empty name. Very long pages and deep
nesting: whole, without recursion. Unclosed, crossed and stray tags: as a browser would roughly do. Repeated rows: each gets its
row. Empty tables: empty result. Columns of the result replace input columns of the same name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.reputation import parts
from scoreloom.llm.shared import written

#: A subtree is a template if it stands with so many different articles of its host, and with so large a share of them.
PAGES, SHARE = 10, 0.3

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
LABEL = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("body html caption dd dt li option optgroup legend summary tbody td tfoot th thead tr".split())
#: Tags that an open element of these tags ends at, up to the container that shields it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
SHIELDS = frozenset("td th caption button object".split())

DROPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video nav footer aside form button select textarea input dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
DROPPED_LABELS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion related reply replies "
    "share sharing sidebar social sponsor sponsored subscribe teaser toolbar widget".split()
)
#: Labels that count on an article element, and those that count only outside the main text.
ARTICLE_LABELS = frozenset("ad advert comment comments promo related reply replies teaser".split())
OUTER_TAGS, OUTER_LABELS = frozenset(["header"]), frozenset("header masthead topbar".split())


class Element:
    __slots__ = ("tag", "labels", "named", "inside", "main", "dropped", "outer", "hash")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.inside, self.hash = tag, [], None
        self.labels, self.named, role, hidden = frozenset(), "", "", False
        if attributes and "=" in attributes or "hidden" in attributes:
            for name, value in ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name in ("class", "id", "role"):
                    value = html.unescape(value.strip("\"'")).lower()
                    if name == "role":
                        role = value.strip()
                    else:
                        self.labels |= frozenset(LABEL.findall(value))
                        self.named += f" {name}={value}"
                elif name == "hidden":
                    hidden = True
        self.main = tag in ("main", "article") or role == "main"
        labels = self.labels & (ARTICLE_LABELS if tag == "article" else DROPPED_LABELS) if tag not in ("html", "body", "main") else ()
        # True: for certain; "unless": if no main text stands inside
        self.dropped = tag in DROPPED or role in DROPPED_ROLES or hidden or ("unless" if labels and tag != "article" else bool(labels))
        self.outer = tag in OUTER_TAGS or bool(self.labels & OUTER_LABELS)


def parse(text: str) -> Element:
    """The tree of a page: an element's `inside` holds texts and elements in order."""
    root = Element("", "")
    open_ = [root]
    at, end = 0, len(text)
    while at < end:
        found = TAG.search(text, at)
        if not found:  # a quote that never ends must not hide the tags after it
            found = LOOSE.search(text, at)
        if not found:
            open_[-1].inside.append(text[at:])
            break
        if found.start() > at:
            loose = LOOSE.search(text, at, found.start()) if "<" in text[at : found.start()] else None
            found = loose or found
            if found.start() > at:
                open_[-1].inside.append(text[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            _close(open_, tag)
            continue
        if tag in ENDS_PARAGRAPH:
            _close(open_, "p", SHIELDS)
        if tag in CLOSES:
            closing, shields = CLOSES[tag]
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in shields:
                    break
                if open_[k].tag in closing:
                    del open_[k:]
        element = Element(tag, found[3])
        open_[-1].inside.append(element)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(text, at)
            at = close.end() if close else end
        elif tag not in VOID and not found[3].endswith("/"):
            open_.append(element)
    return root


def _close(open_: list[Element], tag: str, shields: frozenset = frozenset()) -> None:
    """End the innermost open element of this tag; an inline end tag doesn't end blocks."""
    for k in range(len(open_) - 1, 0, -1):
        now = open_[k].tag
        if now == tag:
            del open_[k:]
            return
        if now in shields or (tag not in BLOCK and now in BLOCK) or (tag == "p" and now in ENDS_PARAGRAPH):
            return


def _ordered(root: Element) -> list[Element]:
    """All elements, each after the elements inside it."""
    order, waiting = [], [root]
    while waiting:
        element = waiting.pop()
        order.append(element)
        waiting.extend(x for x in element.inside if type(x) is Element)
    return order[::-1]


def hash_subtrees(root: Element) -> list[int]:
    """Sets `hash` on every element that has text inside, 64 bits; returns the hashes of all but the root."""
    for element in _ordered(root):
        made = []
        for x in element.inside:
            if type(x) is Element:
                if x.hash is not None:
                    made.append(f"\x01{x.hash:x}\x01")
            elif x and not x.isspace():
                made.append(" ".join(x.split()))
        if made and element.tag not in RAW:
            value = xxhash.xxh64_intdigest(f"{element.tag}{element.named}\x02{''.join(made)}")
            element.hash = value - (1 << 64) if value >= 1 << 63 else value
    return [e.hash for e in _ordered(root)[:-1] if e.hash is not None]


def main_text(root: Element, template: frozenset = frozenset()) -> str:
    """Text of the main part without boilerplate and without the subtrees whose hash is in `template`."""
    has_main = set()  # ids of elements with main text inside
    for element in _ordered(root):
        if any(type(x) is Element and (id(x) in has_main or (x.main and x.dropped is not True)) for x in element.inside):
            has_main.add(id(element))
    only = id(root) in has_main
    blocks, now = [], []

    def end() -> None:
        text = " ".join(html.unescape("".join(now)).split())
        if text:
            blocks.append(text)
        now.clear()

    waiting: list = [(root, not only)]  # what is still to come, last first; whether the main text has begun
    while waiting:
        x, begun = waiting.pop()
        if x is None:
            end()
        elif type(x) is not Element:
            if begun:
                now.append(x)
        elif x.tag == "br":
            now.append(" ")
        else:
            holds = id(x) in has_main
            if x.dropped is True or (x.dropped and not holds) or (x.hash is not None and x.hash in template):
                if x.tag in BLOCK:
                    end()
                continue
            inner = only and begun or x.main
            if x.outer and not inner and not holds:
                continue
            if x.tag in BLOCK:
                end()
                waiting.append((None, False))
            waiting.extend((y, begun or x.main) for y in reversed(x.inside))
    end()
    return "\n".join(blocks)


def extract(pages: DataFrame, url: str = "url", page: str = "html", into: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all but the html) and the main text."""
    keep = [c for c in (keep if keep is not None else [c for c in pages.columns if c != page]) if c.lower() != into.lower()]
    host, _ = parts(url)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                signs, subtrees = [], []
                for value in batch.column("page"):
                    root = parse(value.as_py() or "")
                    sign = xxhash.xxh64_intdigest(main_text(root))
                    signs.append(sign - (1 << 64) if sign >= 1 << 63 else sign)
                    subtrees.append(list(set(hash_subtrees(root))))
                yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(signs, pa.int64()), pa.array(subtrees, pa.list_(pa.int64()))], ["host", "article", "subtrees"])

    seen = pages.select(host.alias("host"), F.col(page).alias("page")).mapInArrow(hashed, "host string, article long, subtrees array<long>")
    # null stands for the page itself, so that one aggregation also counts the host's articles
    seen = seen.select("host", "article", F.explode(F.concat(F.array(F.lit(None).cast("long")), "subtrees")).alias("subtree"))
    counts = written(seen.distinct().groupBy("host", "subtree").agg(F.count("*").alias("articles")).where(F.col("articles") >= PAGES), "subtrees")
    articles = counts.where("subtree is null").select("host", F.col("articles").alias("all"))
    templates = counts.where("subtree is not null").join(articles, "host").where(F.col("articles") >= SHARE * F.col("all"))
    templates = written(templates.groupBy("host").agg(F.collect_list("subtree").alias("template")), "templates")

    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField(into, T.StringType(), False)])
    names = [f"k{k}" for k in range(len(keep))]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                made = []
                for value, template in zip(batch.column("page"), batch.column("template"), strict=True):
                    root = parse(value.as_py() or "")
                    gone = frozenset(template.as_py() or ())
                    if gone:
                        hash_subtrees(root)
                    made.append(main_text(root, gone))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(made, pa.string())], [*keep, into])

    rows = pages.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], host.alias("host"), F.col(page).alias("page"))
    return rows.join(templates, "host", "left").select(*names, "page", "template").mapInArrow(texts, schema)
