"""Main text of pages by site style trees.

The pages of a host are merged into one tree: a node is the path of an
element (tags with their classes, without positions), its contents are the hashes of the
text blocks that pages show there (of their set; their order doesn't count). Over the pages of a host that have a
node:

- presentation: the entropy of the node's layouts (its sequence of children),
- content: the entropy of its texts,

both as a share of the largest entropy that so many pages can have. A node
whose text is the same on most pages (low importance), in a host with enough
pages, is removed with everything below it from the pages that show a text
repeated there; pages with a text of their own keep it, and so does a page with
running text of an article below the node. Removed as well is what is furniture by its kind
on any site: the fixed lists of tags, roles and class words below. What is left
inside ``<article>`` or ``<main>`` is the main text, or else all that is left of the body; of
several articles side by side, the longest one is the page's own.

Only hashes travel to the merge, one row per page and node; per host and node they are
combined before the shuffle, and verdicts come back to the pages as
short lists of path hashes with the hashes of their repeated texts.

Defined cases: null html or html without text gives the empty string; a null or
odd url is the host of the empty name; repeated rows are extracted row by row;
unclosed and stray tags are repaired as browsers mostly do; a long or deeply nested page takes
time in proportion to its length; of articles of one length the first counts; an empty table gives an
empty result. A block's white space is one space; blocks are joined by an empty line.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, q, small, small_batches
from .url_filters import host_of

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot "
                  "th thead tr ul".split())
FURNITURE = frozenset("head nav header footer aside form menu dialog button label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLASS_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
                        "cookies disclaimer disqus footer login masthead menu modal nav navbar navigation newsletter "
                        "notice notices overlay pager pagination popup promo promoted promotion related replies reply share sharing "
                        "sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
#: Words that may stand beside them in one class name; with any other word, the name tells of the text.
BESIDE = frozenset("a area articles aside bar block body bottom box btn button buttons card center col column container content dialog div "
                   "element feed form global group header heading hint holder icon icons id inline inner item items label large layer left "
                   "link links list main media message mobile module more news note outer page panel policy posts primary right row secondary section "
                   "site slot small space stories sub tags text thread title tools top unit v wrap wrapper x zone".split())
#: Of an article, only these make it a reader's; and these begin class names that describe a layout.
COMMENT_WORDS = frozenset("comment comments disqus reply replies".split())
LAYOUT = frozenset("has with without no is".split())
#: Elements that end an open one of the first list when they begin.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}
#: Elements that a closing of the inner ones doesn't cross.
SCOPE = frozenset("article section div table ul ol dl td th body html nav aside header footer form main blockquote".split())

#: A node needs this many pages and an importance of at most this to be removed for its
#: repetition. Importance is the mean over pages of log(pages / pages with the same text), as a
#: share of log(pages); a text is a repeated one where its own share is at most this, too, so a
#: node has pages^0.3 repeated texts at most.
MIN_PAGES = 5
MAX_IMPORTANCE = 0.3
#: Up to this many hosts with dull branches are broadcast: some 20 MB, at a few paths each.
BROADCAST_HOSTS = 50_000

#: Nodes that are never dull: the trunk, and running text in an article.
INNER = frozenset("article main".split())
TRUNK = frozenset("html body main article".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd figure figcaption table tbody tr td th".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
                   r"|<([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
SPACES = re.compile(r"\s+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MASK = (1 << 64) - 1


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def _is_furniture(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """By tag, role or class words. A header inside an article is part of it."""
    if tag in FURNITURE and not (tag == "header" and inside):
        return True
    if attrs.get("role", "").strip().lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if tag in ("html", "body", "main"):
        return False
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        found = [word.lower() for word in WORD.findall(token)]
        if not found or found[0] in LAYOUT:  # "has-sidebar" tells of the page, not of this element
            continue
        kinds = COMMENT_WORDS if tag == "article" else CLASS_WORDS
        if not kinds.isdisjoint(found) and all(word in CLASS_WORDS or word in BESIDE for word in found):
            return True
        if found[-1] == "header" and not inside and tag != "article":
            return True
    return False


class Open(NamedTuple):
    """An element that is open."""

    tag: str
    furniture: bool
    main: bool          # in an article or main element
    article: int        # number of the outermost article around, or 0
    node: int           # of the innermost block
    block: int          # its place among the open elements, or -1
    block_furniture: bool
    closable: dict[str, int]  # places of elements that the start of another may end, up to the next scope


ROOT = Open("", False, False, 0, 0, -1, False, {})
CLOSABLE = frozenset(t for tags in CLOSES.values() for t in tags) | {"p"}


class Block(NamedTuple):
    """A text block, in page order."""

    node: int
    text: str
    furniture: bool
    main: bool
    article: int


class Page:
    """Text blocks of a page and the tree of its paths.

    A node is one path of block elements; nodes stand in order of their first
    element, so parents come before children. What is asked at every tag is kept with the open elements:
    no step walks up the tree.
    """

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        # per node: parent, step, hash of the path, steps of its children, in an article or main element, never dull
        self.parent, self.step, self.key, self.children, self.inner, self.fixed = [0], [""], [0], [[]], [False], [False]
        self._node: dict[tuple[int, str], int] = {}
        self._open: list[Open] = []
        self._places: dict[str, list[int]] = {}
        self._articles = 0
        self._text: list[str] = []
        at = 0
        while at < len(source):
            m = TOKEN.search(source, at)
            if m is None:
                self._add(source[at:])
                break
            self._add(source[at:m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if tag in RAW:
                    if tag not in ("svg", "math") or not m[3].rstrip().endswith("/"):
                        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(source, at)
                        at = end.end() if end else len(source)
                    continue
                self._start(tag, m[3])
            elif m[1]:
                self._end(m[1].lower())
        self._flush()

    def _top(self) -> Open:
        return self._open[-1] if self._open else ROOT

    def _add(self, raw: str) -> None:
        """Text of the block that is open; that of inline furniture is dropped."""
        top = self._top()
        if raw and (not top.furniture or top.block_furniture):
            self._text.append(raw)

    def _flush(self) -> None:
        if self._text:
            text = SPACES.sub(" ", entities.unescape("".join(self._text))).strip()
            if text:
                top = self._top()
                self.blocks.append(Block(top.node, text, top.block_furniture, self.inner[top.node], top.article))
            self._text = []

    def _child(self, parent: int, step: str, tag: str) -> int:
        at = self._node.get((parent, step))
        if at is None:
            at = self._node[parent, step] = len(self.parent)
            self.parent.append(parent)
            self.step.append(step)
            self.key.append(_hash(f"{self.key[parent]}/{step}"))
            self.children.append([])
            self.inner.append(self.inner[parent] or tag in INNER)
            self.fixed.append(tag in TRUNK or (self.inner[parent] and tag in RUNNING))
        self.children[parent].append(step)
        return at

    def _start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self._add(" ")
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        if tag in BLOCK:
            self._flush()
            self._close(("p",))
        if tag in CLOSES:
            self._close(CLOSES[tag])
        attrs = _attributes(raw) if raw.strip(" /\n\t\r") else {}
        top, place = self._top(), len(self._open)
        furniture = top.furniture or _is_furniture(tag, attrs, top.main)
        article = top.article
        if tag == "article" and not article:
            article = self._articles = self._articles + 1
        closable = {} if tag in SCOPE else top.closable
        if tag in CLOSABLE:
            closable = closable | {tag: place}
        node, block, block_furniture = top.node, top.block, top.block_furniture
        if tag in BLOCK:
            named = ".".join(sorted(attrs.get("class", "").lower().split()))
            node, block, block_furniture = self._child(node, f"{tag}.{named}" if named else tag, tag), place, furniture
        self._open.append(Open(tag, furniture, top.main or tag in INNER, article, node, block, block_furniture, closable))
        self._places.setdefault(tag, []).append(place)

    def _cut(self, place: int) -> None:
        """End the element at a place and all inside it."""
        for o in reversed(self._open[place:]):
            self._places[o.tag].pop()
        del self._open[place:]

    def _close(self, tags: tuple[str, ...]) -> None:
        """End the innermost open element of these, if no scope lies between."""
        closable = self._top().closable
        place = max((closable.get(t, -1) for t in tags))
        if place >= 0:
            self._flush()
            self._cut(place)

    def _end(self, tag: str) -> None:
        places = self._places.get(tag)
        if not places or (tag not in BLOCK and places[-1] < self._top().block):
            return  # a stray end
        if self._top().block >= places[-1]:
            self._flush()
        self._cut(places[-1])

    def below(self) -> list[int | None]:
        """Per node a hash of all blocks below, whatever their order; None where there are none."""
        out: list[int | None] = [None] * len(self.parent)
        for block in self.blocks:
            out[block.node] = ((out[block.node] or 0) + _mixed(block.text)) & MASK
        for node in range(len(out) - 1, 0, -1):
            if out[node] is not None:
                out[self.parent[node]] = ((out[self.parent[node]] or 0) + out[node]) & MASK
        return out

    def path(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.step[node])
            node = self.parent[node]
        return "/".join(reversed(steps))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _mixed(text: str) -> int:
    """One of 2**64 numbers, which may be added to others."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), 1)


def _signed(number: int) -> int:
    return number - (1 << 63)


def _node_kernel(named: bool):
    """(host, path, layout, content) of the nodes above a text block: of all, with paths as text, if ``named``, or
    else of those that can be dull, with paths as hashes."""
    types = (pa.string(), pa.string() if named else pa.int64(), pa.int64(), pa.int64())

    def run(batches):
        for batch in batches:
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if source:
                    page = Page(source)
                    rows += [(host, page.path(n) if named else page.key[n], _hash(" ".join(page.children[n])), _signed(content))
                             for n, content in enumerate(page.below()) if n and content is not None and (named or not page.fixed[n])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                 ["host", "path", "layout", "content"])
    return run


def _counted(pages: DataFrame, url: str, html: str, named: bool = False) -> DataFrame:
    """``n`` pages of each ``(host, path, layout, content)``."""
    small_batches(pages.sparkSession)
    nodes = pages.select(F.coalesce(host_of(q(url)), F.lit("")).alias("host"), q(html).cast("string").alias("html")).mapInArrow(
        _node_kernel(named), f"host string, path {'string' if named else 'long'}, layout long, content long")
    return nodes.groupBy("host", "path", "layout", "content").agg(F.count("*").alias("n"))


def site_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, path, pages, presentation, content, importance)`` of each node: both
    entropies as shares of log(pages), and the larger of them."""
    return _tree(_counted(pages, url, html, named=True))


def _tree(counted: DataFrame) -> DataFrame:
    entropy = lambda c: counted.groupBy("host", "path", c).agg(F.sum("n").alias("n")).groupBy("host", "path").agg(
        F.sum("n").alias("pages"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias(c))
    both = entropy("layout").join(entropy("content").drop("pages"), ["host", "path"])
    share = lambda c: F.when(F.col("pages") > 1, F.col(c) / F.log("pages")).otherwise(1.0)
    out = both.select("host", "path", "pages", share("layout").alias("presentation"), share("content").alias("content"))
    return out.withColumn("importance", F.greatest("presentation", "content"))


def _extract_kernel(batches):
    for batch in batches:
        texts = []
        for source, dull in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            texts.append(main_text(source, {path: frozenset(contents) for path, contents in dull or ()}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])


def _removed(page: Page, dull: dict[int, frozenset[int]]) -> list[bool]:
    """Per node, whether it goes from this page or lies in a branch that goes: its text there is a
    repeated one, and no running text that isn't furniture lies below."""
    running = [False] * len(page.parent)
    for block in page.blocks:
        running[block.node] |= page.fixed[block.node] and not block.furniture
    for node in range(len(running) - 1, 0, -1):
        running[page.parent[node]] |= running[node]
    content, out = page.below(), [False] * len(running)
    for node in range(1, len(out)):
        repeated = dull.get(page.key[node])
        out[node] = out[page.parent[node]] or (repeated is not None and not running[node] and content[node] is not None
                                               and _signed(content[node]) in repeated)
    return out


def main_text(source: str | None, dull: dict[int, frozenset[int]] | None = None) -> str:
    """Main text of a page, without furniture and without the branches of ``dull`` whose
    text on this page has one of the hashes given there."""
    if not source:
        return ""
    page = Page(source)
    own = [b for b in page.blocks if not b.furniture]
    gone = _removed(page, dull) if dull else None
    left = [b for b in own if not gone[b.node]] if gone else own
    left = left or own
    size: dict[int, int] = {}
    for b in left:
        if b.article:
            size[b.article] = size.get(b.article, 0) + len(b.text)
    longest = max(size, key=size.get, default=0)
    inner = [b for b in left if b.main and b.article in (0, longest)]
    return "\n\n".join(b.text for b in inner or left)


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: dict[str, str] | None = None,
            min_pages: int = MIN_PAGES, max_importance: float = MAX_IMPORTANCE) -> DataFrame:
    """One row per row of ``pages``: the columns of ``keep`` (new name -> name) and ``text``.

    Dull branches are collected per host as paths, of which a template has few, each with
    the hashes of its repeated texts: a page with another text there keeps it. The
    running text of an article (paragraphs, headings, lists, tables) is never
    removed for repetition, at any depth: pages may be copies of each other. A page of which
    nothing would be left keeps all that isn't furniture.
    """
    counted = _counted(pages, url, html)
    branches = _tree(counted).where((F.col("pages") >= min_pages) & (F.col("importance") <= max_importance))
    repeated = (F.log("pages") - F.log("n")) <= max_importance * F.log("pages")
    texts = branches.select("host", "path", "pages").join(counted.groupBy("host", "path", "content").agg(F.sum("n").alias("n")), ["host", "path"]).where(repeated)
    lists = texts.groupBy("host", "path").agg(F.collect_list("content").alias("contents"))
    dull = small(cut(lists.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "contents"))).alias("dull"))), BROADCAST_HOSTS)
    keep = keep or {"page_id": "page_id", url: url}
    slim = pages.select(F.struct(*[q(o).alias(n) for n, o in keep.items()]).alias("row"), q(html).cast("string").alias("html"),
                        F.coalesce(host_of(q(url)), F.lit("")).alias("_host"))
    named = slim.join(dull.withColumnRenamed("host", "_of"), F.col("_host") == F.col("_of"), "left").select("row", "html", "dull")
    shape = slim.schema["row"].dataType.simpleString()
    return named.mapInArrow(_extract_kernel, f"row {shape}, text string").select("row.*", "text")
