"""Main text of web pages by template deduction over equivalence classes.

Each page becomes a sequence of tokens: one for each element's path (tag names and class or id words from the root), one
for each text block at its path. On the pages of a host, tokens with the same *occurrence vector* (how often they occur
on each page) form an equivalence class; a class that is on enough of the host's pages and has enough tokens is taken for
output of the template. A class's tokens are valid if they nest: the path of every token's parent is a token that is at
least as frequent. Template text is what the valid classes say themselves; the slots that remain hold a page's own data.

The *main slot* is the innermost template element, once on each page, that holds at least ``SLOT_SHARE`` of the text of
the host's pages that isn't in links, menus and the like; an article or main element isn't looked into. Its text without
template text is the main text, but for nested parts whose element (menu, aside, form) or whole class, id or role value
(advert, comments) says that they are something else.

Pages without the slot, and hosts with too few pages for a template, are read by their markup alone: text in an article or
main element, else text outside elements whose kind or name tells a menu, header, footer, sidebar, notice, advert, form
or comment list. What only a name or a form around it puts out comes back inside an article or main element, and where
nothing else is left of a page.

Copies of one page on a host would look like a template, so pages of a host with the same blocks count once. Occurrence
vectors are compared by sums of (count x hash of page), which merge map-side; a host that holds a third of all pages is
spread by salt when its template joins its pages.

Defined results: null or empty html gives an empty text; a null url is a host of its own; repeated rows get equal rows;
hosts with fewer than ``LEAST_PAGES`` different pages have no template; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_map, tune, written

#: Pages from which on a host's template is deduced, share of them that a class must be on, tokens it must have.
LEAST_PAGES, SUPPORT, LEAST_TOKENS = 10, 0.9, 3

#: Share of a host's own text that the element of the main slot holds at least.
SLOT_SHARE = 0.6

SALTS = 256

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_OUT = frozenset("head nav aside footer form script style noscript template iframe svg math button select textarea input dialog menu title".split())
_PAGE_PARTS = frozenset("header".split())
#: Words of class, id and role values that name what isn't main text.
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar comment comments commentlist respond disqus cookie cookies notice notices consent gdpr alert newsletter subscribe subscription menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended widget popup modal overlay pagination pager toolbar login signup search skip".split())
#: Comments, related pages: their items are often article elements, which don't bring them back.
_NEVER = frozenset("comment comments commentlist comment-list comments-area comment-body respond disqus related recommended".split())
_NAMES |= _NEVER | frozenset("ad-banner cookie-banner cookie-notice cookie-consent site-header site-footer page-footer main-menu main-nav nav-menu site-nav social-share share-buttons related-posts".split())
#: Whether a block is out: not, by a name or a form, by its element's kind.
_IN, _NAMED, _KIND = 0, 1, 2
_MAIN = frozenset(("article", "main"))
#: A start tag that ends an open paragraph, or an open element of its own kind.
_ENDS_P = _BLOCK - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup"}
_ENDS_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|([^<]++)|<", re.S)
_LABEL = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-zA-Z]+")


#: Elements that can hold the main slot.
_HOLDS = frozenset("body div section article main td center".split())


class Element:
    __slots__ = ("tag", "path", "main", "out", "inside", "link", "held", "depth", "began")

    def __init__(self, tag: str, path: int, main: bool, out: int, inside: bool, link: bool, held: bool, depth: int, began: int):
        self.tag, self.path, self.main, self.out = tag, path, main, out
        #: Below the main slot; below a link; may hold the main slot; text before it.
        self.inside, self.link, self.held, self.depth, self.began = inside, link, held, depth, began


class Block(NamedTuple):
    path: int
    text: str
    main: bool
    out: int
    inside: bool


def _token(*parts: str | int) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


ROOT = _token("")


def parsed(page: str, slot: int | None = None) -> tuple[list[Block], dict[int, list[int]]]:
    """The text blocks of a page, and of every path of a block element [parent, depth, elements, own text below or -1].

    A path is named by a hash of its parent's name and its own tag and names. Own text is what no link, menu or named part
    holds; -1 stands for elements that can't hold the main slot. All steps are constant time but for elements closed.
    """
    stack = [Element("", ROOT, False, _IN, slot == ROOT, False, True, 0, 0)]
    opened: dict[str, list[int]] = {}  # places in the stack of each tag
    held = [0]  # places of block elements
    blocks: list[Block] = []
    paths: dict[int, list[int]] = {}
    text: list[str] = []
    linked = own = 0

    def flush() -> None:
        nonlocal own, linked
        if text:
            if whole := " ".join(entities.unescape("".join(text)).split()):
                e, top = stack[held[-1]], stack[-1]  # a block belongs to the nearest element that isn't inline
                blocks.append(Block(e.path, whole, top.main, top.out, e.inside))
                if top.out == _IN:
                    own += max(0, len(whole) - linked)
            text.clear()
        linked = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            e = stack.pop()
            opened[e.tag].pop()
            if held[-1] == len(stack):
                held.pop()
                row = paths[e.path]
                row[3] = row[3] + own - e.began if e.held and row[3] >= 0 else -1

    at, last = 0, page.rfind(">")
    while at < len(page):
        if at > last:  # nothing more is markup
            text.append(page[at:])
            break
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[7] is not None:
            text.append(m[7])
            if stack[-1].link:
                linked += len(m[7])
            continue
        slash, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0] == "<":
                text.append("<")
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag in _BLOCK or tag in _RAW:
            flush()
        if slash:
            # an inline end tag doesn't close blocks that its element holds
            if (places := opened.get(tag)) and (tag in _BLOCK or held[-1] <= places[-1]):
                close(places[-1])
            continue
        if tag in _ENDS_P and stack[held[-1]].tag == "p":
            close(held[-1])
        for other in _ENDS_SELF.get(tag, ()):
            if stack[held[-1]].tag == other:
                close(held[-1])
        top = stack[-1]
        names: list[str] = []
        whole: set[str] = set()
        role_main = False
        for label in _LABEL.finditer(rest):
            value = (label[2] or label[3] or label[4] or "").lower()
            role_main |= label[1].lower() == "role" and value == "main"
            names += _WORD.findall(value)
            whole.update(value.split())
        main = top.main or tag in _MAIN or role_main
        opens = (tag in _MAIN or role_main) and not top.main
        out = _IN if opens and top.out == _NAMED else top.out
        if (tag in _OUT and tag != "form") or (tag in _PAGE_PARTS and not top.main):
            out = _KIND
        elif tag not in ("html", "body", "main") and not role_main and not _NAMES.isdisjoint(whole):
            out = max(out, _NAMED if _NEVER.isdisjoint(whole) else _KIND)
        elif tag == "form":
            out = max(out, _NAMED)
        block = tag in _BLOCK
        path = _token(top.path, tag, *names) if block else top.path
        e = Element(tag, path, main, out, top.inside or path == slot, top.link or tag == "a", tag in _HOLDS and not top.main, top.depth + block, own)
        if block:
            row = paths.setdefault(path, [top.path, e.depth, 0, 0 if e.held else -1])
            row[2] += 1
        if tag in _RAW and not rest.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = len(page) if end is None else end.start()
            closing = page.find(">", at)
            at = len(page) if closing < 0 else closing + 1
            continue
        if tag not in _VOID and not rest.endswith("/"):
            opened.setdefault(tag, []).append(len(stack))
            if block:
                held.append(len(stack))
            stack.append(e)
    flush()
    close(1)
    paths[ROOT] = [ROOT, 0, 1, own]
    return blocks, paths


def tokens_of(page: str | None) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """(fingerprint of all blocks, tokens): a token has its name, its parent's, its count, its depth and own text below."""
    blocks, paths = parsed(page or "")
    tokens = [(p, parent, n, depth, own) for p, (parent, depth, n, own) in paths.items()]
    texts: dict[tuple[int, int], int] = {}
    for x in blocks:
        k = _token(x.path, x.text), x.path
        texts[k] = texts.get(k, 0) + 1
    return _token(*(y for x in blocks for y in x[:2])), tokens + [(t, p, n, -1, -1) for (t, p), n in texts.items()]


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, slot): the tokens of each host's valid equivalence classes, and the main slot's element (null: none).

    ``pages`` has host and html.
    """

    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("token", "parent", "n", "depth", "own")]))

    def run(batch: pa.RecordBatch) -> dict:
        rows = [tokens_of(x) for x in batch.column("html").to_pylist()]
        flat = np.array([t for r in rows for t in r[1]], np.int64).reshape(-1, 5)
        ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], ["token", "parent", "n", "depth", "own"]))
        return {"host": batch.column("host"), "page": [r[0] for r in rows], "tokens": tokens.cast(kind)}

    seen = written(arrow_map(pages.select("host", "html"), "html", run, "host string, page long, tokens array<struct<token:bigint,parent:bigint,n:bigint,depth:bigint,own:bigint>>"), "page-tokens")
    # one row for each different page of a host
    distinct = seen.groupBy("host", "page").agg(F.min("tokens").alias("tokens"))
    counts = distinct.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    # each token's occurrence vector, as a fingerprint, and its support
    on_page = distinct.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.*")
    vector = F.sum(F.col("n").cast("decimal(12,0)") * F.xxhash64("page").cast("decimal(20,0)"))
    least_own = F.min("own").alias("least_own")
    per_token = on_page.groupBy("host", "token").agg(F.count("*").alias("support"), vector.alias("vector"), F.min("parent").alias("parent"), F.max("n").alias("most"), F.min("depth").alias("depth"), F.sum("own").alias("own"), least_own)
    frequent = written(per_token.join(counts, "host").filter(F.col("support") >= SUPPORT * F.col("pages")), "frequent-tokens")
    classes = frequent.groupBy("host", "vector", "support").agg(F.count("*").alias("size")).filter(F.col("size") >= LEAST_TOKENS)
    members = frequent.join(classes.drop("size"), ["host", "vector", "support"]).select("host", "token", "parent", "support", "most", "depth", "own", "least_own")
    # nesting: the parent's path is a token at least as frequent, or the root
    over = frequent.select("host", F.col("token").alias("parent"), F.col("support").alias("above"))
    valid = members.join(over, ["host", "parent"], "left").filter((F.col("above") >= F.col("support")) | (F.col("parent") == ROOT))
    # the main slot: elements that hold most of a host's own text are nested in each other, and it is the innermost
    whole = frequent.filter(F.col("token") == ROOT).select("host", F.col("own").alias("all_own"))
    slots = valid.join(whole, "host").filter((F.col("least_own") >= 0) & (F.col("most") == 1) & (F.col("token") != ROOT) & (F.col("own") > 0) & (F.col("own") >= SLOT_SHARE * F.col("all_own")))
    slots = slots.groupBy("host").agg(F.max_by("token", "depth").alias("slot"))
    return valid.groupBy("host").agg(F.collect_set("token").alias("template")).join(slots, "host", "left")


def main_blocks(page: str | None, template: frozenset[int], slot: int | None = None) -> list[str]:
    """The blocks of a page's own main text: what the main slot holds beside template and parts of other kinds; on pages
    without the slot, what articles hold or what no name or kind puts out."""
    blocks, _ = parsed(page or "", slot)
    own = [x for x in blocks if not template or _token(x.path, x.text) not in template]
    if found := [x.text for x in own if x.inside and x.out == _IN]:
        return found
    for level in (_IN, _NAMED):
        inside = any(x.main and x.out <= level for x in blocks)
        if found := [x.text for x in own if x.out <= level and x.main >= inside]:
            return found
    return []


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page (columns page_id, url, html)."""
    tune(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    found = written(templates(rows), "templates")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    spread = rows.select("host", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).alias("salt")).distinct().join(found, "host")
    joined = salted.join(spread, ["host", "salt"], "left").select("page_id", "url", "html", "template", "slot")

    def run(batch: pa.RecordBatch) -> dict:
        texts = []
        for page, host, slot in zip(batch.column("html").to_pylist(), batch.column("template"), batch.column("slot").to_pylist(), strict=True):
            tokens = frozenset(host.values.to_pylist()) if host.is_valid else frozenset()
            texts.append("\n".join(main_blocks(page, tokens, slot)))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": list(map(len, texts))}

    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_map(joined, "html", run, f"page_id {kind}, url string, text string, n_chars long")
