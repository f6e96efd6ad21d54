"""Main text of HTML pages by equivalence-class template deduction.

Per host, over all of its pages:

1. Tokens.  A page is a sequence of tokens: every opened and every closed tag with its path of open elements, and every
   text block with the path it stands under.
2. Occurrence vectors.  A token's vector holds how often it occurs on each page of the host.  Tokens with equal vectors
   form an equivalence class.  Vectors are never built: a sum of hashes of (page, count) over the pages, and the
   number of pages, tell them apart, so the classes come from one grouped sum however many pages a host has.
3. Valid classes.  Candidates stand on at least ``LEAST_PAGES`` pages and ``LEAST_SHARE`` of the host's.  A class's tokens are
   ordered by their mean place.  Every page is read again: a class must occur there as its whole sequence, once or
   again and again, without crossing another class, and always in the same slot (the gap between two neighbouring tokens) of
   the class around it.  Classes that don't on more than ``MAX_BROKEN`` of their pages are dropped (of two that
   cross, the one on fewer pages).
4. The template is the tree of valid classes.  Text blocks in valid classes are template text; all others fill slots.
5. The main region is an element of the template that opens once a page: from the document down, the child that holds
   the bulk of the text in slots over all pages of the host (``BULK``, or half of it if it is an article, main or called so).
   Element, class, id and role names only weigh that text: ``NAME_WEIGHT`` times more in a main element, as many times
   less in a menu, header, form, advert and the like.
6. The main text is what the region's slots hold, in order, without elements inside the region that are menus, forms, reader
   comments and so on by name.  Template text is left out of every region, whatever its element.  Where that would leave less than
   ``SLOT_SHARE`` of the region's text, the page's text itself stands in order on most pages of its host (copies of one article): such a page is
   judged alone.

Pages of hosts without a template, and pages that lack their template's region, are judged by their own elements and names alone: the article or
main element; a region named so that holds half of the text; else all that isn't side text.

Null html counts as empty.  Broken markup is read as browsers do for the elements that matter here (implied ends of p, li
and the like; unclosed elements).  Repeated rows count each for itself and are extracted alike.  A null URL has the empty host.  An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.tables import mapped_by_key, settle

LEAST_PAGES = 3
LEAST_SHARE = 0.5
#: Share of a class's pages, at most, on which it may be broken or stand elsewhere.
MAX_BROKEN = 0.05
#: How much more text counts in an element that is main by name, and less in one that is side by name.
NAME_WEIGHT = 4.0
#: Share of the text around it that an element without a main name must hold to be entered.
BULK = 0.9
#: Share of the main region's text that its slots must hold to be the main text alone; with less the page is a copy of others of its host.
SLOT_SHARE = 0.25
#: Template tokens that are broadcast at most; beyond that pages are joined to them by host.
BROADCAST_TOKENS = 200_000

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
DROPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video select option button input textarea form nav header footer aside menu dialog title".split())
IMPLIED_END = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
CONTAINERS = frozenset("html body div section article main center td tr table tbody fieldset details blockquote form nav header footer aside".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Words of class, id and role names.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside "
    "comment comments disqus replies respond notice notices cookie cookies consent gdpr popup modal newsletter subscribe signup share sharing social related recommended pagination pager "
    "toolbar login search complementary contentinfo alert widget".split()
)
MAIN_WORDS = frozenset("article content main post entry story maincontent articlebody postcontent entrycontent".split())
#: A side word behind one of these says what else the page has ("layout-with-sidebar", "has-header").
MODIFIERS = frozenset("with without has have no".split())
#: Of these, a side word in a name doesn't count (an article may be called a story with a header image).
MAIN_ELEMENTS = ("article", "main")

_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|![^>]*(?:>|$)|\?[^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$))", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|$)", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WHITE = re.compile(r"\s+")


#: Kinds of tokens, and what an opened element is by its own name and attributes.
OPEN, CLOSE, TEXT = 1, 2, 3
SIDE, MAIN, ARTICLE, MAIN_ELEMENT, BLOCK, GONE = 4, 8, 16, 32, 64, 128
_FLAGS = 8  # bits below the value: the length of a text, the end of an opened element
_M64 = (1 << 64) - 1


@dataclass
class Block:
    text: str
    side: bool  # in a region that is never main text
    main: bool  # in an article, main or the like
    sure: bool = False  # in an article or main element
    inner: bool = False  # in an article or main element of a region that is side by name
    side_at: int = -1  # token number of the innermost element around it that is side by itself


@dataclass
class Page:
    keys: list[int] = field(default_factory=list)  # template tokens in order
    info: list[int] = field(default_factory=list)  # kind, flags and value of each
    blocks: list[Block] = field(default_factory=list)
    places: list[int] = field(default_factory=list)  # token number of each block


@cache
def _child(parent: int, part: str) -> int:
    """The key of a path one element longer."""
    return xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass"), parent)


def path_key(*parts: str) -> int:
    """The key of an opened element's token, from the document down; parts as in ``_roles``."""
    key = 0
    for p in parts:
        key = _child(key, p)
    return key


def text_key(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), path ^ 0x5BD1E995)


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I)


def _side_name(value: str) -> bool:
    """Whether a token of a class, id or role has a side word that no modifier stands before."""
    for token in value.split():
        words = [w.lower() for w in _NAME_WORD.findall(token)]
        if any(w in SIDE_WORDS and not MODIFIERS.intersection(words[:k]) for k, w in enumerate(words)):
            return True
    return False


def _roles(name: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Part of the path; whether the element is a side region, a main region, side by name only; whether its name has a side word."""
    marks, side, main, named, word = [], name in DROPPED, name in MAIN_ELEMENTS, False, False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden":
            side |= key == "hidden" or value == "true"
            continue
        words = [w.lower() for w in _NAME_WORD.findall(value)]
        marks.append(f"{key}={value}")
        if any(w in MAIN_WORDS for w in words) or {a + b for a, b in zip(words, words[1:])} & MAIN_WORDS:
            main = True
        word |= _side_name(value)
    if word and name not in MAIN_ELEMENTS and name not in ("body", "html"):
        named = True
    if side or named:
        main = False
    return (f"{name}[{';'.join(sorted(marks))}]" if marks else name), side or named, main, named and not side, word


_known_roles: dict[tuple[str, str], tuple] = {}


def _cached_roles(name: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Attributes repeat on the pages of a site, but some are endless (links): the table is emptied when it is full."""
    found = _known_roles.get((name, attributes))
    if found is None:
        if len(_known_roles) > 20_000:
            _known_roles.clear()
            _child.cache_clear()
        found = _known_roles[name, attributes] = _roles(name, attributes)
    return found


@dataclass(slots=True)
class Element:
    name: str
    key: int
    inline: bool
    side: bool
    main: bool
    sure: bool
    named: bool  # side by a name only, not by an element
    inner: bool
    at: int  # its token
    side_at: int


def parse(html: str | None) -> Page:
    """Tokens and text blocks of a page, in order; time in proportion to its length, however deep it is."""
    page, html = Page(), html or ""
    keys, info = page.keys, page.info
    stack = [Element("", 0, False, False, False, False, False, False, -1, -1)]
    places: dict[str, list[int]] = {}  # where on the stack elements of a name are
    solid = [0]  # where on the stack elements are that are not inline
    text: list[str] = []
    at, n = 0, len(html)

    def flush() -> None:
        if text:
            own = _WHITE.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if own:
                home = stack[solid[-1]]
                page.blocks.append(Block(own, home.side, home.main, home.sure, home.inner, home.side_at))
                page.places.append(len(keys))
                keys.append(text_key(home.key, own))
                info.append(len(own) << _FLAGS | TEXT)

    def last(*names: str) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    def close(to: int) -> None:
        if text and (solid[-1] >= to or stack[-1].side != stack[to - 1].side):
            flush()
        for k in range(len(stack) - 1, to - 1, -1):
            e = stack.pop()
            places[e.name].pop()
            if not e.inline:
                solid.pop()
            info[e.at] |= len(keys) << _FLAGS

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text.append(html[at:])
            break
        m = _TAG.match(html, lt)
        if not m:
            text.append(html[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            text.append(html[at:lt])
        at = m.end()
        slash, name, attributes = m.groups()
        if not name:
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
            continue
        inline = name in INLINE
        if slash:
            k = last(name)
            if k > 0 and (not inline or solid[-1] < k):
                key = stack[k].key
                close(k)
                keys.append(key ^ _M64)
                info.append(CLOSE)
            elif not inline:
                flush()
            continue
        if name in RAW:
            end = _raw_end(name).search(html, at)
            at = end.end() if end else n
            continue
        if name in CLOSES_P and (k := last("p")) > 0 and k > last("td", "th", "li", "table", "button", "object"):
            close(k)
        if name in IMPLIED_END and (k := last(*IMPLIED_END[name])) > 0 and k > last("ul", "ol", "dl", "table", "select"):
            close(k)
        part, side, main, named, word = _cached_roles(name, attributes) if attributes else _cached_roles(name, "")
        parent = stack[-1]
        if not inline or (side and not parent.side):
            flush()
        key = _child(parent.key, part)
        flags = OPEN | SIDE * side | MAIN * main | ARTICLE * (name == "article") | MAIN_ELEMENT * (name == "main") | BLOCK * (name in CONTAINERS)
        if name in VOID:
            keys.append(key)
            info.append(flags | (len(keys) << _FLAGS))
            continue
        away = parent.side or side
        element = name in MAIN_ELEMENTS
        by_name = (parent.named and (not side or named)) or (named and not parent.side)
        inner = (parent.inner and not side) or (element and parent.side and by_name and not word)
        places.setdefault(name, []).append(len(stack))
        if not inline:
            solid.append(len(stack))
        stack.append(Element(name, key, inline, away, (parent.main or main) and not away, (parent.sure or element) and not away, by_name, inner and not parent.sure, len(keys), len(keys) if side else parent.side_at))
        keys.append(key)
        info.append(flags)
    if len(stack) > 1:
        flush()
        close(1)
    flush()
    return page


def host_of(url: str | None) -> str:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without."""
    if not url or "://" not in url:
        return ""
    rest = url[url.index("://") + 3 :]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


STREAM = "host string, page long, keys array<long>, info array<long>"


def token_streams(pages: DataFrame) -> DataFrame:
    """(host, page, keys, info) over (page_id, url, html): the tokens of each page in order; page is a hash of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, ids, keys, info = [], [], [], []
            for url, html in zip(b.column(1).to_pylist(), b.column(2)):
                html = html.as_py()
                page = parse(html)
                hosts.append(host_of(url))
                ids.append(xxhash.xxh64_intdigest((html or "").encode("utf-8", "surrogatepass"), 7))
                keys.append(_signed(page.keys))
                info.append(np.array(page.info, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(_signed(ids)), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, info))], names=["host", "page", "keys", "info"])

    return pages.mapInArrow(run, STREAM)


def _streams_of(b: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, int]]:
    hosts, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
    keys, info = b.column(2), b.column(3)
    for i, (host, page) in enumerate(zip(hosts, ids)):
        yield host, page, keys[i].values.to_numpy(), info[i].values.to_numpy(), i


def token_vectors(streams: DataFrame) -> DataFrame:
    """(host, token, kind, flags, pages, n, place, vector) of ``token_streams``: a row per token of a host.

    n is all its occurrences, place the sum of its first place on each page.  Sums are taken in each task before they
    leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, int], list] = {}
            for host, page, keys, info, _ in _streams_of(b):
                tokens, first, counts = np.unique(keys, return_index=True, return_counts=True)
                flags = info[first] & ((1 << _FLAGS) - 1)
                for k, at, n, f in zip(tokens.tolist(), first.tolist(), counts.tolist(), flags.tolist()):
                    row = sums.setdefault((host, k), [f, 0, 0, 0, 0])
                    row[1] += 1
                    row[2] += n
                    row[3] += at
                    # a product with an odd number and the count, mixed once more by the last hash
                    row[4] += ((page ^ n * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 >> 7) & _M64
            columns = [pa.array([h for h, _ in sums], pa.string()), pa.array([k for _, k in sums], pa.int64()), *(pa.array([r[i] for r in sums.values()], pa.int64()) for i in range(4)), pa.array(_signed([r[4] & _M64 for r in sums.values()]))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "token", "flags", "pages", "n", "place", "vector"])

    found = streams.mapInArrow(run, "host string, token long, flags long, pages long, n long, place long, vector long")
    # sums of hashes wrap around; halves are added apart, as SQL sums must not overflow
    low, high = F.expr("vector & 4294967295"), F.expr("shiftright(vector, 32) & 4294967295")
    return (
        found.groupBy("host", "token")
        .agg(F.max("flags").alias("flags"), F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("place").alias("place"), F.sum(low).alias("lo"), F.sum(high).alias("hi"))
        .withColumn("vector", F.xxhash64(F.expr("(lo + shiftleft(hi, 32))")))
        .withColumn("kind", F.expr("flags & 3"))
        .drop("lo", "hi")
    )


def candidates(streams: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Tokens of classes with enough pages: host, token, kind, flags, cls, idx (place in its class), size (of the class), pages, single.

    They are as many for a host as its pages hold tokens on average (over ``least_share``), however many pages it has.
    """
    hosts = streams.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    often = token_vectors(streams).filter(F.col("pages") >= least_pages).join(hosts.withColumnRenamed("host", "__h"), F.col("host") == F.col("__h")).filter(F.col("pages") >= least_share * F.col("host_pages"))
    own = Window.partitionBy("host", "cls")
    return often.withColumn("cls", F.xxhash64("vector", "pages")).select(
        "host", "token", "kind", "flags", "cls", (F.row_number().over(own.orderBy("place", "token")) - 1).alias("idx"), F.count(F.lit(1)).over(own).cast("int").alias("size"), "pages", (F.col("pages") == F.col("n")).alias("single"),
    )


_ENTRY = "array<struct<token:bigint,kind:bigint,flags:bigint,cls:bigint,idx:int,size:int,pages:bigint,single:boolean>>"
Entry = dict  # token -> (kind, flags, cls, idx, size, pages, single)


def _entries(listed) -> Entry:
    return {r["token"]: (r["kind"], r["flags"], r["cls"], r["idx"], r["size"], r["pages"], r["single"]) for r in listed or ()}


def read_classes(keys: list[int], entries: Entry) -> tuple[set[int], dict[int, set], list[tuple[int, int]]]:
    """Classes broken on a page, the slots that each class stands in there, and the slot (class, gap) of each token that is in no class.

    The page is read once.  Open instances of classes lie on a stack; a token continues its class or begins a new instance
    in the slot on top.  An instance that is left open when one below goes on crosses it.
    """
    broken: set[int] = set()
    slots: dict[int, set] = {}
    filled = []
    stack: list[list] = []  # class, next place, size, pages
    for i, k in enumerate(keys):
        e = entries.get(k)
        if e is None:
            filled.append((i, (stack[-1][0], stack[-1][1]) if stack else (0, 0)))
            continue
        _, _, cls, idx, size, pages, _ = e
        if cls in broken:
            continue
        if idx == 0:
            if any(x[0] == cls for x in stack):
                broken.add(cls)
                stack = [x for x in stack if x[0] != cls]
                continue
            slots.setdefault(cls, set()).add((stack[-1][0], stack[-1][1]) if stack else (0, 0))
            if size > 1:
                stack.append([cls, 1, size, pages])
            continue
        at = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][0] == cls), -1)
        if at < 0 or stack[at][1] != idx:
            broken.add(cls)
            stack = [x for x in stack if x[0] != cls]
            continue
        if crossed := [x for x in stack[at + 1 :]]:
            if any(x[3] > pages for x in crossed):  # one on more pages is left open: this class crosses it
                broken.add(cls)
                stack = [x for x in stack if x[0] != cls]
                continue
            broken.update(x[0] for x in crossed)
            del stack[at + 1 :]
        stack[at][1] += 1
        if stack[at][1] == size:
            stack.pop()
    broken.update(x[0] for x in stack)
    return broken, slots, filled


def weighted_text(keys: np.ndarray, info: np.ndarray, entries: Entry, weight: float) -> list[tuple[int, int, float]]:
    """(element, template element around it, weighted text in its slots) for every template element that opens once a page."""
    out: dict[int, list] = {}
    around: list[tuple[int, int, int]] = []  # end, side and main flags, template element or 0
    flags, values = (info & ((1 << _FLAGS) - 1)).tolist(), (info >> _FLAGS).tolist()
    for i, k in enumerate(keys.tolist()):
        while around and around[-1][0] <= i:
            around.pop()
        kind = flags[i] & 3
        if kind == OPEN:
            e = entries.get(k)
            above = around[-1] if around else (0, 0, 0)
            own = k if e is not None and e[6] else 0
            if own:
                out[own] = [above[2], 0.0]
            around.append((values[i], above[1] | flags[i], own or above[2]))
        elif kind == TEXT and k not in entries and around:
            _, marks, element = around[-1]
            w = values[i] * (1 / weight if marks & SIDE else 1.0) * (weight if marks & MAIN and not marks & SIDE else 1.0)
            while element:
                row = out[element]
                row[1] += w
                element = row[0]
    return [(k, above, w) for k, (above, w) in out.items()]


def _by_host(rows: DataFrame, columns: list[str], host: Column, table: DataFrame, read: Callable, schema: str) -> DataFrame:
    return mapped_by_key(rows, columns, host, table, "host", ["entries", "region"], "n", BROADCAST_TOKENS, lambda entries, region: (_entries(entries), region), read, schema)


_CHECKED = "host string, what int, a long, b long, c long, x double"


def checked(streams: DataFrame, table: DataFrame, name_weight: float) -> DataFrame:
    """What all pages say of the candidates in ``table`` (host, entries), summed.

    what 0: class a stood whole in slot (b, c) on x pages (only there on the page); 1: class a was broken on x pages; 2: element a in element b holds x weighted
    text.
    """

    def read(b: pa.RecordBatch, table: Callable) -> pa.RecordBatch:
        sums: dict[tuple, float] = {}
        for host, _, keys, info, i in _streams_of(b):
            known = table(host, i)
            if known is None:
                continue
            entries, _ = known
            broken, slots, _ = read_classes(keys.tolist(), entries)
            for c in broken:
                sums[host, 1, c, 0, 0] = sums.get((host, 1, c, 0, 0), 0) + 1
            for c, where in slots.items():
                if c not in broken:
                    if len(where) > 1:
                        sums[host, 1, c, 0, 0] = sums.get((host, 1, c, 0, 0), 0) + 1
                    else:
                        key = (host, 0, c, *next(iter(where)))
                        sums[key] = sums.get(key, 0) + 1
            for element, above, w in weighted_text(keys, info, entries, name_weight):
                key = (host, 2, element, above, 0)
                sums[key] = sums.get(key, 0) + w
        return pa.RecordBatch.from_arrays([pa.array([k[j] for k in sums], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))] + [pa.array(list(sums.values()), pa.float64())], names=["host", "what", "a", "b", "c", "x"])

    return _by_host(streams, ["host", "page", "keys", "info"], F.col("host"), table, read, _CHECKED).groupBy("host", "what", "a", "b", "c").agg(F.sum("x").alias("x"))


def main_region(elements: pd.DataFrame, bulk: float = BULK) -> int | None:
    """The main region of one host's template elements (token, above, flags, x)."""
    rows = {r.token: r for r in elements.itertuples()}
    below: dict[int, list] = {}
    for r in rows.values():
        below.setdefault(r.above if r.above in rows else 0, []).append(r)
    here, named = None, lambda r: r.flags & (ARTICLE | MAIN_ELEMENT | MAIN)
    while True:
        whole = here.x if here is not None else sum(r.x for r in below.get(0, []))
        if here is not None and here.flags & ARTICLE:
            break
        open_to = [r for r in below.get(here.token if here is not None else 0, []) if r.x > 0 and r.flags & BLOCK and (here is None or not named(here) or r.flags & ARTICLE)]  # a main region is entered no further but for its article
        fit = [r for r in open_to if r.x >= (0.5 if named(r) else bulk) * whole]
        if not fit:
            break
        here = max(fit, key=lambda r: (r.x, r.token))
    return here.token if here is not None else None


def templates(streams: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, max_broken: float = MAX_BROKEN, name_weight: float = NAME_WEIGHT, bulk: float = BULK) -> DataFrame:
    """(host, n, entries, region) over settled ``streams``: the tokens of valid classes and the main region's token, settled.

    Each entry has its class, its place in it, and the class and gap (slot) it is nested in.
    """
    found = settle(candidates(streams, least_pages, least_share))
    entry = F.struct("token", "kind", "flags", "cls", "idx", "size", "pages", "single")
    listed = settle(found.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.collect_list(entry).alias("entries")).withColumn("region", F.lit(None).cast("long")))
    said = settle(checked(streams, listed, name_weight))
    classes = found.filter("idx = 0").select("host", "cls", "pages")
    nested = said.filter("what = 0").groupBy(F.col("host").alias("__h"), F.col("a").alias("__c")).agg(F.max(F.struct("x", "b", "c")).alias("s"))
    valid = classes.join(nested, (F.col("host") == F.col("__h")) & (F.col("cls") == F.col("__c"))).filter(F.col("s.x") >= (1 - max_broken) * F.col("pages"))
    valid = valid.select(F.col("host").alias("__h"), F.col("cls").alias("__c"), F.col("s.b").alias("parent"), F.col("s.c").alias("gap"))
    kept = found.join(valid, (F.col("host") == F.col("__h")) & (F.col("cls") == F.col("__c"))).drop("__h", "__c")
    flags = kept.filter(F.col("single") & (F.col("kind") == OPEN)).select(F.col("host").alias("__h"), F.col("token").alias("__t"), "flags")
    weights = said.filter("what = 2").join(flags, (F.col("host") == F.col("__h")) & (F.col("a") == F.col("__t"))).select("host", F.col("a").alias("token"), F.col("b").alias("above"), "flags", "x")
    one = weights.groupBy("host", "token", "flags").agg(F.max(F.struct("x", "above")).alias("m"), F.sum("x").alias("x")).select("host", "token", "flags", "x", F.col("m.above").alias("above"))

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [g["host"].iloc[0]], "region": pd.array([main_region(g, bulk)], "Int64")})

    regions = one.groupBy("host").applyInPandas(choose, "host string, region long").withColumnRenamed("host", "__h")
    whole = kept.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("token", "kind", "flags", "cls", "idx", "size", "pages", "single", "parent", "gap")).alias("entries"))
    return settle(whole.join(regions, F.col("host") == F.col("__h"), "left").select("host", "n", "entries", "region"))


def page_text(page: Page) -> str:
    """The main text of a page judged alone, by its elements and names.

    Names decide only where they hold the bulk: a labelled region at least half of the text that no label excludes, and an
    article in a region that is side by name more than that text.
    """
    if any(b.sure for b in page.blocks):
        return "\n\n".join(b.text for b in page.blocks if b.main)
    size = lambda blocks: sum(len(b.text) for b in blocks)
    plain = [b for b in page.blocks if not b.side]
    inner = [b for b in page.blocks if b.inner]
    labelled = [b for b in page.blocks if b.main]
    if size(inner) > size(plain):
        chosen = inner
    elif labelled and 2 * size(b for b in plain if b.main) >= size(plain):
        chosen = labelled
    else:
        chosen = plain
    return "\n\n".join(b.text for b in chosen)


def main_text(page: Page, entries: Entry | None = None, region: int | None = None) -> str:
    """What the slots of the template's main region hold, in order; without a template (or the region), the page judged alone."""
    at = -1
    if entries and region is not None:
        key = region & _M64
        at = next((i for i, k in enumerate(page.keys) if k == key), -1)
    if at < 0:
        return page_text(page)
    end = page.info[at] >> _FLAGS
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    region_text = [(b.text, signed(page.keys[i]) in entries) for b, i in zip(page.blocks, page.places) if at < i < end and b.side_at <= at]
    slots = [text for text, repeats in region_text if not repeats]
    enough = sum(map(len, slots)) >= SLOT_SHARE * sum(len(text) for text, _ in region_text)
    return "\n\n".join(slots) if enough else page_text(page)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Per row: page_id, url, text (main text; empty if none), n_chars.  Options are those of ``templates``."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    table = templates(settle(token_streams(own)), **options)

    def read(b: pa.RecordBatch, table: Callable) -> pa.RecordBatch:
        texts = []
        for i, (url, html) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
            texts.append(main_text(parse(html.as_py()), *(table(host_of(url), i) or (None, None))))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    after = F.substring_index(F.substring_index(F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "/", 1), "?", 1), "#", 1)
    host = F.when(F.col("url").contains("://"), F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")
    return _by_host(own, ["page_id", "url", "html"], host, table, read, SCHEMA)
