"""Main text of web pages by site-template removal.

Each page is parsed once into text blocks, each with the hashes of the element subtrees it
lies in. Spark counts, per host, on how many different pages a subtree occurs (exact copies
of a page count once); subtrees that recur on many pages are the site's template and are
deleted. Elements whose name, class, id or role says that they are no article text (menus,
adverts, comments, forms and the like) go as well, recurring or not. If a page marks its
article, that is the main text; inside it only containers that recur are deleted, so that
repeated sentences stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, texts

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>|<[!?][^>]*>|<[a-zA-Z/!?][^<>]*\Z", re.S)
#: Tags are looked for within so many characters; longer ones as long as a page has spent less than so many times its length on them.
_WINDOW, _PATIENCE = 4096, 16
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text: it ends at their own end tag only.
_RAW = frozenset("script style textarea title noscript iframe template xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table article main section div body html".split())
#: Inside a marked article these stay though they recur.
_PIECES = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th tr".split())
#: Never article text.
_CHROME = frozenset("nav footer aside form button select datalist dialog menu svg canvas object audio video map head".split())
_CHROME_OUTSIDE = frozenset(["header"])
#: Whole class names and ids, "_" read as "-".
_CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets "
    "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper adsbygoogle comment-form comment-list comment-section comments-area comments-list comments-section cookie-banner cookie-bar cookie-consent cookie-notice footer-links footer-menu footer-nav left-sidebar main-menu main-nav main-navigation nav-bar nav-links nav-menu newsletter-form newsletter-signup page-footer page-navigation post-comments post-navigation related-articles related-content related-links related-posts related-stories right-sidebar share-bar share-buttons share-links sharing-buttons side-bar sidebar-left sidebar-right site-footer site-menu site-nav site-navigation social-buttons social-icons social-links social-media social-share sponsored-content sponsored-links top-nav widget-area".split()
)
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form toolbar".split())


@dataclass(frozen=True)
class HtmlParams:
    min_pages: int = 5
    #: hosts with fewer pages than min_pages, but as many as these: subtrees on all of them
    few_pages: int = 3
    #: short pieces, say a number in a cell, recur by chance: they must be on this share of the host's pages too
    min_share: float = 0.02
    short: int = 25
    #: a subtree with more of its page's text than this is content, not template
    max_page_share: float = 0.5
    #: the same for a subtree inside a marked article
    max_article_share: float = 0.25
    #: marked articles with less than this of the text that may be main are taken for teasers
    min_article_share: float = 1 / 3


@dataclass
class _Element:
    tag: str
    parent: _Element | None
    barred: bool  # chrome by its tag, role or a hidden attribute
    named: bool  # chrome by its class or id, unless it holds most of the page's text
    mark: bool  # marks an article
    chrome: bool = False  # or in an element that is
    article: bool = False
    parts: list[str] = field(default_factory=list)  # what its hash is made of
    size: int = 0
    hash: int = 0


@dataclass
class _Block:
    text: str
    element: _Element


def _is_barred(tag: str, attributes: str) -> bool:
    if tag in _CHROME:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name == "role" and m[2]:
            if m[2].strip("\"'").lower() in _CHROME_ROLES:
                return True
        elif name in ("hidden",) or (name == "aria-hidden" and m[2] and "true" in m[2].lower()):
            return True
    return False


def _is_named(tag: str, attributes: str) -> bool:
    if not attributes or tag in ("html", "body"):
        return False
    return any(m[1].lower() in ("class", "id") and m[2] and not _CHROME_NAMES.isdisjoint(m[2].strip("\"'").lower().replace("_", "-").split()) for m in _ATTRIBUTE.finditer(attributes))


def _is_article(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or bool(attributes and re.search(r"role\s*=\s*[\"']?(?:main|article)\b", attributes, re.I))


def parse(page: str, p: HtmlParams) -> tuple[list[_Block], list[_Element]]:
    """Text blocks in page order and all elements, from markup however broken."""
    root = _Element("#root", None, False, False, False)
    stack = [root]
    done: list[_Element] = []
    blocks: list[_Block] = []
    run: list[str] = []
    owner = root

    def flush() -> None:
        nonlocal run
        if run:
            text = " ".join("".join(run).split())
            run = []
            if text:
                blocks.append(_Block(text, owner))

    def say(raw: str) -> None:
        nonlocal owner
        if raw:
            if not run:
                owner = stack[-1]
            text = unescape(raw) if "&" in raw else raw
            run.append(text)
            text = " ".join(text.split())
            if text:
                stack[-1].parts.append(text)
                stack[-1].size += len(text)

    def close(count: int) -> None:
        for _ in range(count):
            e = stack.pop()
            opened[e.tag] -= 1
            if e.tag not in _INLINE:
                flush()
            e.hash = xxhash.xxh3_64_intdigest("\x00".join([e.tag, *e.parts])) >> 1
            stack[-1].parts.append(f"\x01{e.hash}")
            stack[-1].size += e.size
            done.append(e)

    at = spent = 0
    n = len(page)
    opened: dict[str, int] = {}  # how many elements of each kind are open
    while at < n:
        i = page.find("<", at)
        if i < 0:
            say(page[at:])
            break
        m = None
        if page.startswith(("<!--", "<![CDATA["), i):
            m = _MARKUP.match(page, i)
        elif page[i + 1 : i + 2].isalpha() or page[i + 1 : i + 2] in ("/", "!", "?"):
            m = _MARKUP.match(page, i, min(n, i + _WINDOW))
            cut_short = i + _WINDOW < n and (m is None or m.end() == i + _WINDOW or m[5])
            if cut_short and spent < _PATIENCE * n:
                m = _MARKUP.match(page, i)
                spent += m.end() - i if m and not m[5] else n - i  # as much as was read
            elif cut_short and m and not m[5]:
                m = None
        if m is None:
            say(page[at : i + 1])
            at = i + 1
            continue
        say(page[at:i])
        at = m.end()
        name = m[2] or m[5]  # the second form: quotes that are not in pairs
        if name is None:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if opened.get(tag):
                depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
                close(len(stack) - depth)
            elif tag not in _INLINE:
                flush()
            continue
        attributes = m[3] or m[6] or ""
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            if tag not in _INLINE:
                flush()
            continue
        if tag in _ENDS_P or tag in _SIBLINGS:
            targets = {"p"} if tag in _ENDS_P else _SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1) if any(opened.get(t) for t in targets) else ():
                if stack[i].tag in targets:
                    close(len(stack) - i)
                    break
                if stack[i].tag in _SCOPES:
                    break
        if tag not in _INLINE:
            flush()
        if tag in _VOID or attributes.endswith("/") and tag not in _ENDS_P:
            if tag == "br":
                run.append(" ")
            continue
        mark = _is_article(tag, attributes)
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(_Element(tag, stack[-1], _is_barred(tag, attributes), not mark and _is_named(tag, attributes), mark))
    flush()
    close(len(stack) - 1)
    for e in reversed(done):  # parents come first
        up = e.parent
        e.article = up.article or (e.mark and not up.chrome)
        e.chrome = up.chrome or e.barred or (e.named and e.size <= p.max_page_share * root.size) or (e.tag in _CHROME_OUTSIDE and not up.article)
    for b in blocks:  # an inline element at the start of a block does not stand for all of it
        while b.element.tag in _INLINE and b.element.size < 0.9 * len(b.text):
            b.element = b.element.parent
    return blocks, done


def host_of(url: str | None) -> str:
    m = re.match(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


@dataclass
class ParsedPage:
    """What is left to decide about a page: ``blocks`` (text, number of the subtree it lies in, or -1) may be main text;
    ``names`` are the subtrees around them that may be template, ``parents`` the numbers of those around these, or -1."""

    blocks: list[tuple[str, int]]
    names: list[int]
    parents: list[int]
    subtrees: list[int]  # all that may be template
    content: int  # a hash of the page

    def without(self, drop: set[int]) -> str:
        """The text without the blocks that lie in subtrees to be dropped."""
        gone: list[bool] = []
        for name, up in zip(self.names, self.parents, strict=True):  # those around come first
            gone.append(name in drop or (up >= 0 and gone[up]))
        return "\n".join(t for t, at in self.blocks if at < 0 or not gone[at])


def parse_page(page: str | None, p: HtmlParams) -> ParsedPage:
    blocks, elements = parse(page or "", p)
    total = sum(len(b.text) for b in blocks)
    main = [b for b in blocks if not b.element.chrome]
    inside = sum(len(b.text) for b in main if b.element.article)
    marked = inside > 0 and inside >= p.min_article_share * sum(len(b.text) for b in main)

    def may_go(e: _Element) -> bool:
        if marked and e.article:
            return not e.mark and e.tag not in _PIECES and e.tag not in _INLINE and e.size <= p.max_article_share * total
        return e.size <= p.max_page_share * total

    def name(e: _Element) -> int:  # odd for short pieces
        return e.hash & ~1 | (e.size < p.short and (e.tag in _PIECES or e.tag in _INLINE))

    out = ParsedPage([], [], [], sorted({name(e) for e in elements if e.size and may_go(e)}), xxhash.xxh3_64_intdigest("\n".join(b.text for b in blocks)) >> 1)
    number: dict[int, int] = {}  # of an element, by identity: the nearest subtree around it that may go

    def around(e: _Element) -> int:
        path = []
        while e.parent is not None and id(e) not in number:
            path.append(e)
            e = e.parent
        at = number.get(id(e), -1)
        for e in reversed(path):
            if may_go(e):
                out.names.append(name(e))
                out.parents.append(at)
                at = len(out.names) - 1
            number[id(e)] = at
        return at

    for b in main:
        if not marked or b.element.article:
            out.blocks.append((b.text, around(b.element)))
    return out


_PARSED = "page_id long, url string, host string, row long, content long, subtrees array<long>, text string, blocks array<struct<text:string,at:int>>, names array<long>, parents array<int>"


def parsed_pages(pages: DataFrame, p: HtmlParams) -> DataFrame:
    block = pa.struct([("text", pa.string()), ("at", pa.int32())])

    def run(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            found = [parse_page(h, p) for h in texts(part.column(2))]
            # blocks that lie in no candidate subtree are joined at once
            plain = [not x.names for x in found]
            some = lambda values, kind: pa.array([None if ok else v for ok, v in zip(plain, values, strict=True)], kind)
            arrays = [
                part.column(0), part.column(1), pa.array([host_of(u) for u in texts(part.column(1))]), part.column(3),
                pa.array([x.content for x in found], pa.int64()), pa.array([x.subtrees for x in found], pa.list_(pa.int64())),
                pa.array([x.without(set()) if ok else None for ok, x in zip(plain, found, strict=True)], pa.string()),
                some([[{"text": t, "at": at} for t, at in x.blocks] for x in found], pa.list_(block)),
                some([x.names for x in found], pa.list_(pa.int64())), some([x.parents for x in found], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "host", "row", "content", "subtrees", "text", "blocks", "names", "parents"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.monotonically_increasing_id().alias("row"))
    return map_batches(rows, _PARSED, run)


def without_templates(left: DataFrame) -> DataFrame:
    """page_id, url, text of parsed pages whose subtrees in ``drop`` go."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.select(["blocks", "names", "parents", "drop"]).to_pylist()
        text = [ParsedPage([(b["text"], b["at"]) for b in r["blocks"]], r["names"], r["parents"], [], 0).without(set(r["drop"])) for r in rows]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return map_batches(left.select("page_id", "url", "blocks", "names", "parents", "drop"), "page_id long, url string, text string", run)


def host_templates(parsed: DataFrame, p: HtmlParams) -> DataFrame:
    """host, subtree: those on at least min_pages different pages, however many the host has."""
    each = parsed.select("host", "content", F.explode(F.concat(F.array(F.lit(-1).cast("long")), "subtrees")).alias("subtree")).distinct()
    counts = each.groupBy("host", "subtree").agg(F.count("*").alias("pages"))
    hosts = counts.filter("subtree = -1").select("host", F.col("pages").alias("host_pages"))
    often = F.col("pages") >= F.least(F.lit(p.min_pages), F.greatest(F.lit(p.few_pages), "host_pages"))
    by_chance = (F.col("subtree") % 2 != 0) & (F.col("pages") < p.min_share * F.col("host_pages"))
    some = counts.filter((F.col("subtree") != -1) & (F.col("pages") >= min(p.few_pages, p.min_pages)))
    return some.join(hosts, "host").filter(often & ~by_chance).select("host", "subtree")


def extract(pages: DataFrame, p: HtmlParams = HtmlParams()) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null or empty html, and pages without main text, give an empty text. Repeated rows give
    one result each. Pages without a usable url share the host ''. Other columns are not read.
    """
    # parsed once; both the counts and the texts are read from the shared folder
    parsed = cut(parsed_pages(pages, p))
    templates = host_templates(parsed, p)
    open_pages = parsed.filter(F.col("blocks").isNotNull())
    hits = open_pages.select("row", "host", F.explode(F.array_distinct("names")).alias("subtree")).join(templates, ["host", "subtree"]).groupBy("row").agg(F.collect_set("subtree").alias("drop"))
    left = open_pages.join(hits, "row", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<long>")))
    whole = parsed.filter(F.col("blocks").isNull()).select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"))
    both = whole.unionByName(without_templates(left))
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
