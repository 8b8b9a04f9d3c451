"""Main text of web pages by site template removal.

Each element's subtree is hashed; Spark counts on how many pages of a host a hash is
found, and subtrees that many pages of that host share are its template and go. Inside
articles, distinct article bodies are counted instead of pages, so that an article is no
template, however often it is copied; one that consists for the most part of what others
have too is a near copy and stays whole. On hosts with too few pages to count, the text
is that of the first container the page has. What pages do not share cannot be counted,
so elements that are never main text by their tag or role (menus, headers, footers,
sidebars, forms, scripts) go wherever they stand, and so do those whose class or id says
so (notices, adverts, comments of readers), unless that would take most of an article.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm.memory import lean
from prismlake.llm.urls import host_of
from prismlake.session import durable

#: A subtree is template if at least so many pages of its host have it ...
LEAST_PAGES = 5
#: ... and at least this share of the host's pages.
LEAST_SHARE = 0.2
#: An article stays whole if more than this share of its text is in recurring subtrees.
MOST_RECURRING = 0.5
#: Hashes that count a host's pages and its distinct article bodies; in a template, PAGES says that the host's pages are enough to count.
PAGES, BODIES = 0, 1
#: Templates that every task may hold as 64-bit hashes; beyond, hits are joined page by page.
BROADCAST_TEMPLATES = 2_000_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCKS = frozenset("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - frozenset("body head html caption legend option optgroup summary tbody td tfoot th thead title tr".split())
NEVER = frozenset("nav header footer aside form script style noscript template iframe svg math button select textarea input head menu dialog object embed canvas audio video".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Names of classes and ids for what is not main text; STRONG ones count as the last part of a name too (`site-footer`), and as the first before words of LAYOUT or numbers (`ad-slot-2`, but not `ad-hoc` or `comment-on-war`).
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sidebar nav navbar navigation breadcrumb breadcrumbs cookie cookies consent newsletter subscribe popup modal comment comments disqus footer masthead gdpr".split())
MARKED = STRONG | frozenset("banner promo side-bar menu notice reply replies share sharing social related alert widget login signup toolbar recommended".split())
LAYOUT = frozenset("area bar block body bottom box button card cell col column container content entry form frame group header inner item items label left link links list main menu outer overlay panel placeholder right row section slot space text thread title top unit widget wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

# Quotes count only after an equals sign, so that an apostrophe in a bare value ends nothing.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_PARTS = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")


#: An element in an article that its class alone marks stays if it holds more than this share of the article's text.
MOST_MARKED = 0.5


class Element:
    __slots__ = ("article", "digest", "marked", "never", "parts", "size", "tag")

    def __init__(self, tag: str, parent: Element | None, never: bool, marked: bool):
        self.tag, self.marked = tag, marked
        self.never = never or (parent is not None and parent.never)
        #: The article around it, itself included.
        self.article: Element | None = parent.article if parent is not None and parent.article is not None else self if tag == "article" else None
        self.parts: list[str | Element] = []
        self.digest = self.size = 0


def _named(value: str) -> bool:
    """Whether a class or id names what is not main text."""
    for name in value.lower().split():
        parts = [p for p in _PARTS.split(name) if p] or [name]
        if name in MARKED or parts[-1] in STRONG or (parts[0] in STRONG and all(p in LAYOUT or p.isdigit() for p in parts[1:])):
            return True
    return False


def _judge(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is never main text by its tag, role or hidden, and whether its class or id says so."""
    if tag in NEVER:
        return True, False
    marked = False
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                marked = marked or (tag not in ("article", "main", "body", "html") and _named(value))
            elif (name == "role" and value.lower() in ROLES) or (name == "hidden" and value.lower() in ("", "hidden")):
                return True, marked
    return False, marked


def parse(page: str) -> Element:
    """The tree of a page; unclosed and stray tags are taken as browsers mostly do.

    No recursion, as pages may nest deeply, and no walk to the root for a tag that is
    not open, so the work grows with the page.
    """
    root = Element("", None, False, False)
    line, opened = [root], Counter()
    at, size = 0, len(page)

    def close(depth: int) -> None:
        opened.subtract(e.tag for e in line[depth:])
        del line[depth:]

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            line[-1].parts.append(page[at:])
            break
        if m.start() > at:
            line[-1].parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        depth = len(line) - 1
        if m[1]:
            if opened[tag]:
                # A block's end closes what is open within; an inline end does not pass a block.
                while depth and line[depth].tag != tag and (tag in BLOCKS or line[depth].tag not in BLOCKS):
                    depth -= 1
                if depth and line[depth].tag == tag:
                    close(depth)
            continue
        if tag in CLOSES_P and opened["p"]:
            while depth and line[depth].tag != "p" and line[depth].tag not in BLOCKS:
                depth -= 1
            if line[depth].tag == "p":
                close(depth)
        if tag in SIBLINGS and any(opened[x] for x in SIBLINGS[tag]):
            depth = len(line) - 1
            while depth and line[depth].tag not in SIBLINGS[tag] and line[depth].tag not in WITHIN[tag]:
                depth -= 1
            while depth and line[depth].tag in SIBLINGS[tag]:
                close(depth)
                depth -= 1
        element = Element(tag, line[-1], *_judge(tag, m[3]))
        line[-1].parts.append(element)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            element.parts.append(page[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        line.append(element)
        opened[tag] += 1
    return root


def _walk(root: Element) -> list[Element]:
    """All elements, children after their parents."""
    found = [root]
    for element in found:
        found += [x for x in element.parts if not isinstance(x, str)]
    return found


def read(page: str) -> list[Element]:
    """The elements of a page, children after their parents, with digests and, for what class names mark, its say."""
    elements = _walk(parse(page))
    for element in reversed(elements):
        state = xxhash.xxh3_64(element.tag)
        size = 0
        for x in element.parts:
            if isinstance(x, str):
                if text := _SPACE.sub(" ", x).strip():
                    state.update("\0t" + text)
                    size += len(text)
            else:
                state.update(b"\0e" + x.digest.to_bytes(8, "little"))
                size += 0 if x.never else x.size
        element.digest, element.size = state.intdigest(), size
    for element in elements:
        if element.marked and (element.article is None or element.size <= MOST_MARKED * element.article.size):
            element.never = True
        if element.never:
            for x in element.parts:
                if not isinstance(x, str):
                    x.never = True
    return elements


def _container(elements: list[Element]) -> tuple[str, ...]:
    """The tags whose elements hold the main text: the first of these that the page has."""
    tags = {e.tag for e in elements if not e.never}
    return next(((t,) for t in ("article", "main", "body") if t in tags), ("",))


def _within(digest: int) -> int:
    """The hash of a subtree inside an article, as it is another than outside."""
    return xxhash.xxh3_64_intdigest(b"in" + digest.to_bytes(8, "little"))


def subtrees(elements: list[Element]) -> list[tuple[int, int]]:
    """Distinct (hash, body) of subtrees with text; body is the hash of the article around them, 0 outside. An element that goes anyway is not looked into."""
    found, stack = {(PAGES, 0)}, [(elements[0], 0)]
    while stack:
        element, body = stack.pop()
        if element.never:
            continue
        if element.tag == "article" and not body:
            body = element.digest
            found.add((BODIES, body))
        elif element.tag not in ("", "html", "body", "main") and any(not isinstance(x, str) or x.strip() for x in element.parts):
            found.add((_within(element.digest), body) if body else (element.digest, 0))
        stack += [(x, body) for x in element.parts if not isinstance(x, str)]
    return list(found)


def _copied(article: Element, template: set[int]) -> bool:
    """Whether most of an article's visible text is in recurring subtrees."""
    whole = recurring = 0
    stack = [(article, False)]
    while stack:
        element, known = stack.pop()
        if element.never:
            continue
        known = known or (element is not article and _within(element.digest) in template)
        size = sum(len(_SPACE.sub(" ", x).strip()) for x in element.parts if isinstance(x, str))
        whole, recurring = whole + size, recurring + size * known
        stack += [(x, known) for x in element.parts if not isinstance(x, str)]
    return recurring > MOST_RECURRING * whole


def main_text(elements: list[Element], template: set[int] | None = None) -> str:
    """The main text of a page without subtrees in template: blocks joined by line feeds."""
    root = elements[0]
    tags = _container(elements)
    if template and PAGES in template and any(e.tag == "body" for e in elements):
        tags = ("body",)
    elif template and PAGES in template:
        tags = ("",)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        # References are decoded after blocks are known, so that decoded signs are text and not markup.
        if text := _SPACE.sub(" ", entities.unescape("".join(line))).strip():
            blocks.append(text)
        line.clear()

    # (part, inside a container, closes a block, in an article, that stays whole)
    stack: list[tuple[str | Element | None, bool, bool, bool, bool]] = [(root, tags == ("",), False, False, False)]
    while stack:
        part, inside, closes, article, stays = stack.pop()
        if closes:
            flush()
        elif isinstance(part, str):
            if inside:
                line.append(part)
        else:
            if part.never:
                continue
            if template and part.tag == "article" and not article:
                article, stays = True, _copied(part, template)
            elif template and (not stays and _within(part.digest) in template if article else part.tag not in ("", "html", "body", "main") and part.digest in template):
                continue
            within = inside or part.tag in tags
            if part.tag == "br":
                line.append(" ")
            block = part.tag in BLOCKS
            if block:
                flush()
                stack.append((None, within, True, article, stays))
            stack += [(x, within, False, article, stays) for x in reversed(part.parts)]
    flush()
    return "\n".join(blocks)


@lean
def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, found, bodies = [], [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            own = subtrees(read(page))
            hosts += [host] * len(own)
            found += [x for x, _ in own]
            bodies += [x for _, x in own]
        columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (found, bodies)]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *columns], names=["host", "hash", "body"])


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, hash) of subtrees that recur across pages of a host, inside articles across its distinct article bodies, from rows (host, html); PAGES for hosts with least_pages."""
    rows = pages.mapInArrow(_hashes, "host string, hash long, body long").groupBy("host", "hash", "body").agg(F.count("*").alias("pages"))
    # Outside there is one body, 0, and pages count; inside each body counts once, however many pages have it.
    counts = rows.groupBy("host", "hash").agg(F.sum(F.when(F.col("body") == 0, F.col("pages")).otherwise(1)).alias("pages"), (F.max(F.when(F.col("body") == 0, 0).otherwise(1)) > 0).alias("inside"))
    often = durable(counts.where(F.col("hash").isin(PAGES, BODIES) | (F.col("pages") >= least_pages)))
    whole = often.where(F.col("hash").isin(PAGES, BODIES)).select("host", "inside", F.col("pages").alias("all_pages"))
    return often.where((F.col("hash") != BODIES) & (F.col("pages") >= least_pages)).join(whole, ["host", "inside"]).where(F.col("pages") >= F.col("all_pages") * least_share).select("host", "hash")


def _extract(known: np.ndarray | None):
    """known: sorted keys of templates; None if each row brings its own in column `own`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            hosts, pages = batch.column("host").to_pylist(), batch.column("html").to_pylist()
            own = [None] * len(batch) if known is not None else batch.column("own").to_pylist()
            for host, page, mine in zip(hosts, pages, own, strict=True):
                elements = read(page)
                if known is None:
                    template = {x % (1 << 64) for x in mine or ()}
                elif len(known):
                    found = [x for x, _ in subtrees(elements)]
                    keys = np.array([_key(host, x) for x in found], np.uint64)
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    template = {x for x, hit in zip(found, known[at] == keys, strict=True) if hit}
                else:
                    template = set()
                texts.append(main_text(elements, template))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return lean(run)


def _key(host: str, digest: int) -> int:
    return xxhash.xxh3_64_intdigest(host.encode() + b"\0" + digest.to_bytes(8, "little"))


def extract_pages(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per row of pages: page_id, url, text (empty if none), n_chars in code points.

    Null html is empty; null urls share the empty host. Repeated rows give repeated
    rows and count as pages of their own; extra columns are left out; an empty table
    gives an empty one. Markup that does not nest is taken as browsers mostly do. A
    table of up to BROADCAST_TEMPLATES templates goes to every task, a larger one is
    joined to the pages' hashes.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of("url").alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    templates = durable(site_templates(slim.select("host", "html"), least_pages, least_share))
    ddl = "page_id long, url string, text string, n_chars long"
    if templates.count() <= BROADCAST_TEMPLATES:
        rows = templates.toArrow()
        known = np.sort(np.array([_key(h, x % (1 << 64)) for h, x in zip(rows["host"].to_pylist(), rows["hash"].to_pylist(), strict=True)], np.uint64))
        return slim.mapInArrow(_extract(known), ddl)
    keyed = slim.withColumn("page", F.xxhash64("html"))
    mine = keyed.select("host", "page", "html").distinct().mapInArrow(_page_hashes, "host string, page long, hash long").join(templates, ["host", "hash"]).groupBy("host", "page").agg(F.collect_set("hash").alias("own"))
    return keyed.join(mine, ["host", "page"], "left").select("page_id", "url", "host", "html", "own").mapInArrow(_extract(None), ddl)


@lean
def _page_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [[x for x, _ in subtrees(read(page))] for page in batch.column("html").to_pylist()]
        index = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
        found = np.array([x for xs in own for x in xs], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("host").take(index), batch.column("page").take(index), pa.array(found)], names=["host", "page", "hash"])
