"""Main text of web pages by a site style tree.

A page is read into a DOM of elements and text blocks.  The pages of a host are merged
by the paths of their elements (tag, class and id from the root on), and each node gets
an importance between 0 and 1:

* a presentation node whose tag or role says what it is, or a class or id of nothing but
  such words ("ad", "cookie-notice"), is taken at its word:
  0 for navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles
  and comments;
* a content node elsewhere: 1 minus the entropy of its text over the host's distinct
  pages, log(k) / log(m) for a text that k of m pages show at that path, so 0 for what
  every page repeats and 1 for what one page has alone;
* where a page's article or main part (or else an element with a class or id for it, such
  as "content") holds at least half of its text, that is a prior of 1 for the nodes inside
  and 0 for those outside, which weighs as much as the statistics of PRIOR_PAGES pages:
  it decides on small hosts, the entropy on large ones;
* a class or id that has such a word among others ("with-sidebar", "overflow-hidden") takes
  HINT of the importance of the nodes below, but for articles and main parts;
* a path: the mean of its content nodes' importances.

Branches of low importance are removed from each page; the text of the other blocks,
white space made one space, is joined in page order.  The blocks of all pages are counted,
as hashes shuffled by (host, path, text), which no large host gathers in one task; texts
are not kept between steps but read from the pages again.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.session import Scratch

# HTML element names and the words that name a page's furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
NOISE_TAGS = frozenset(
    "nav header footer aside form script style noscript template iframe svg button select option input textarea menu "
    "dialog head title object embed audio video canvas map xmp noframes label fieldset".split()
)
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split()
)
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promoted "
    "banner banners nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot colophon "
    "sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus discussion "
    "share sharing social related recommended recommendations pagination pager toolbar search copyright legal disclaimer "
    "skip hidden".split()
)
MAIN_WORDS = frozenset("content main article post entry story body text maincontent".split())
CLOSES_P = BLOCK - {"html", "body", "option"}
SCOPE = frozenset("table td th button object caption".split())
PRIOR_PAGES = 16
HINT = 0.25

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAMED = frozenset("class id role hidden aria-hidden style".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Elements whose start closes an open element of the same kind, up to the listed parent.
_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "replace")).digest()[:8], "little", signed=True)


class Node:
    """An element; `path` hashes those of the root on, `prior` is 0 or 1 where its tag or
    attributes tell what it is.  `grade` has bit 2 in an article or main part and bit 1 in
    an element whose class or id names the main text; `weak` tells that it or one around it,
    up to an article or main part, hints at furniture."""

    __slots__ = ("tag", "path", "prior", "noise", "grade", "weak")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag = tag
        found = _attributes(attributes) if attributes else {}
        mark = f"{tag}.{found.get('class', '')}#{found.get('id', '')}" if found else tag
        self.path = _hash(f"{parent.path}/{mark}" if parent else mark)
        around = parent.grade if parent else 0
        self.prior, weak = _prior(tag, found, around & 2 > 0)
        self.noise = (parent is not None and parent.noise) or self.prior == 0
        self.grade = 0 if self.noise else around | _named(found) | 2 * (self.prior == 1)
        self.weak = self.prior != 1 and (weak or (parent is not None and parent.weak))


def _attributes(text: str) -> dict[str, str]:
    """The attributes that matter here; of repeated ones the first counts, as in browsers."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        if (name := m[1].lower()) in _NAMED:
            found.setdefault(name, (m[2] or "").strip("\"'"))
    return found


def _named(found: dict[str, str]) -> int:
    """1 if a class or id is made of words for a page's main text alone."""
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = set(_WORD.findall(_CAMEL.sub(" ", name).lower()))
        if words and words <= MAIN_WORDS:
            return 1
    return 0


def _prior(tag: str, found: dict[str, str], inside: bool) -> tuple[int | None, bool]:
    """(prior, weak): a class or id made of furniture words alone is taken at its word, one
    that has such a word among others is a hint."""
    if tag in NOISE_TAGS and not (inside and tag == "header"):
        return 0, False
    if tag in ("html", "body"):
        return None, False
    weak = False
    if found:
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
            return 0, False
        role = found.get("role", "").lower()
        if role in NOISE_ROLES:
            return 0, False
        for name in f"{found.get('class', '')} {found.get('id', '')}".split():
            for words in (set(_WORD.findall(name.lower())), set(_WORD.findall(_CAMEL.sub(" ", name).lower()))):
                if words and words <= NOISE_WORDS:
                    return 0, False
                weak = weak or bool(words & NOISE_WORDS)
        if role in ("main", "article"):
            return 1, False
    if tag in ("article", "main"):
        return 1, False
    return None, weak


def blocks(page: str) -> list[tuple[int, str, bool, int, bool]]:
    """(path, text, noise, grade, weak): the text blocks of a page in order, with what
    their elements' nodes tell.  Work grows with the page's length, however deep it nests."""
    out: list[tuple[int, str, bool, int, bool]] = []
    stack: list[Node] = []
    count: Counter[str] = Counter()  # of open elements by tag
    pending: list[str] = []
    holder: Node | None = None
    at = 0

    def flush() -> None:
        nonlocal holder
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            if text and holder is not None:
                out.append((holder.path, text, holder.noise, holder.grade, holder.weak))
            elif text:
                out.append((0, text, False, 0, False))
            pending.clear()
        holder = None

    def add(text: str) -> None:
        nonlocal holder
        if not text:
            return
        if stack and stack[-1].noise and not (holder is None or holder.noise):
            return  # furniture inside a paragraph does not interrupt it
        if holder is None:
            holder = next((n for n in reversed(stack) if n.tag in BLOCK or n.noise), stack[-1] if stack else None)
        elif holder.noise and not (stack and stack[-1].noise):
            flush()
            holder = next((n for n in reversed(stack) if n.tag in BLOCK), stack[-1] if stack else None)
        pending.append(text)

    def close_to(k: int) -> None:
        if any(n.tag in BLOCK or n.tag in NOISE_TAGS for n in stack[k:]):
            flush()
        count.subtract(n.tag for n in stack[k:])
        del stack[k:]

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            add(rest)
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1) if count[tag] else ():
                if stack[k].tag == tag:
                    close_to(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag does not reach out of its block
            continue
        if at == len(page) and not m[0].endswith(">"):
            break  # a tag that the page's end cuts off
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1) if count["p"] else ():
                if stack[k].tag == "p":
                    close_to(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in _SAME:
            same, until = _SAME[tag]
            for k in range(len(stack) - 1, -1, -1) if any(count[t] for t in same) else ():
                if stack[k].tag in until:
                    break
                if stack[k].tag in same:
                    close_to(k)
                    if tag != "tr":
                        break
        if tag in BLOCK:
            flush()
        if m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|/|\Z)", re.I).search(page, at)
            if end is None:
                break
            at = page.find(">", end.start()) + 1 or len(page)
            continue
        stack.append(Node(tag, m[3], stack[-1] if stack else None))
        count[tag] += 1
    flush()
    return out


def settle(found: list[tuple[int, str, bool, int, bool]]) -> list[tuple[tuple[int, int | None, bool], str]]:
    """The blocks that are not furniture as ((path, prior, weak), text).

    If articles and main parts hold at least half of their text, or else the elements named
    so, the prior is 1 inside and 0 outside of these; on other pages (a story beside an
    article that is a teaser) there is none."""
    rest = [(path, text, grade, weak) for path, text, noise, grade, weak in found if not noise]
    whole = sum(len(text) for _, text, _, _ in rest)
    for bit in (2, 1):
        if rest and 2 * sum(len(text) for _, text, grade, _ in rest if grade & bit) >= whole:
            return [((path, int(grade & bit > 0), weak), text) for path, text, grade, weak in rest]
    return [((path, None, weak), text) for path, text, _, weak in rest]


def _host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def parse_pages(pages: DataFrame) -> DataFrame:
    """(host, html_hash, page_hash, parts): parts (seq, path, h, prior, weak) has hashes of the paths
    and texts of all blocks that are not furniture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("seq", pa.int32()), ("path", pa.int64()), ("h", pa.int64()), ("prior", pa.int8()), ("weak", pa.bool_())]))
        for batch in batches:
            for start in range(0, len(batch), 128):
                part = batch.slice(start, 128)
                hashes, parts = [], []
                for page in part.column("html").to_pylist():
                    rest = settle(blocks(page or ""))
                    hashes.append(_hash("\n".join(t for _, t in rest)))
                    parts.append(
                        [
                            {"seq": k, "path": path, "h": _hash(text), "prior": prior, "weak": weak}
                            for k, ((path, prior, weak), text) in enumerate(rest)
                        ]
                    )
                yield pa.RecordBatch.from_arrays(
                    [part.column("host"), part.column("html_hash"), pa.array(hashes, pa.int64()), pa.array(parts, kind)],
                    ["host", "html_hash", "page_hash", "parts"],
                )

    schema = "host string, html_hash long, page_hash long, parts array<struct<seq:int,path:long,h:long,prior:tinyint,weak:boolean>>"
    return pages.select(_host().alias("host"), F.xxhash64("html").alias("html_hash"), "html").mapInArrow(run, schema)


def cut_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the blocks that are not furniture, without those whose numbers `drop` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 128):
                part = batch.slice(start, 128)
                texts = []
                for page, drop in zip(part.column("html").to_pylist(), part.column("drop").to_pylist(), strict=True):
                    gone = set(drop or ())
                    rest = settle(blocks(page or ""))
                    texts.append(" ".join(text for k, (_, text) in enumerate(rest) if k not in gone))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html", "drop").mapInArrow(run, f"page_id {kind}, url string, text string")


def extract(pages: DataFrame, scratch: Scratch, least: float = 0.5, least_path: float = 0.3) -> DataFrame:
    """(page_id, url, text) for every row of `pages`.

    Null or empty html, and pages of furniture alone, have the empty text.  A null url
    belongs to the host ''.  A block goes if its own importance is below `least` or its
    path's mean below `least_path`; where a host has one distinct page, nothing repeats and
    the priors decide.  Equal pages count once, so a copied article stays an article."""
    rows = scratch.write(parse_pages(pages), "parsed")
    each = rows.select("host", "html_hash", "page_hash", F.explode("parts").alias("b"))
    each = each.select("host", "html_hash", "page_hash", "b.seq", "b.path", "b.h", "b.prior", "b.weak")
    shown = each.groupBy("host", "path", "h", "page_hash").agg(F.max("prior").alias("prior"), F.min("weak").alias("weak"))
    counted = shown.groupBy("host", "path", "h").agg(
        F.count(F.lit(1)).alias("k"), F.count("prior").alias("told"), F.coalesce(F.sum("prior"), F.lit(0)).alias("inside"),
        F.count_if("weak").alias("weak"),
    )
    sizes = rows.where(F.size("parts") > 0).select("host", "page_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("m"))
    nodes = scratch.write(counted, "counted").join(scratch.write(sizes, "hosts"), "host")
    weight = math.log(PRIOR_PAGES)
    over = F.log("m") + weight * F.col("told") / F.col("k")
    imp = F.when(over > 0, (F.log(F.col("m") / F.col("k")) + weight * F.col("inside") / F.col("k")) / over).otherwise(1.0)
    imp = imp * (1 - HINT * F.col("weak") / F.col("k"))
    nodes = scratch.write(nodes.select("host", "path", "h", "k", imp.alias("imp")), "nodes")
    paths = nodes.groupBy("host", "path").agg((F.sum(F.col("imp") * F.col("k")) / F.sum("k")).alias("path_imp"))
    paths = scratch.write(paths.where(F.col("path_imp") < least_path).select("host", "path"), "low-paths")
    low = nodes.where(F.col("imp") < least).select("host", "path", "h").unionByName(
        nodes.join(paths, ["host", "path"], "left_semi").select("host", "path", "h")
    )
    low = scratch.write(low.distinct(), "low")
    drop = each.join(low, ["host", "path", "h"], "left_semi").groupBy("host", "html_hash").agg(F.collect_set("seq").alias("drop"))
    drop = scratch.write(drop, "drop")
    keyed = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", _host().alias("host"), F.xxhash64("html").alias("html_hash"))
    return cut_pages(keyed.join(drop, ["host", "html_hash"], "left"))
