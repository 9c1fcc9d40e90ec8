"""Main text of web pages: page structure first, then a suffix array for each host.

A page is parsed into blocks of visible text. Scripts, styles, forms, comments and the
like never count. Text inside an article or main element (less its own adverts, menus and
reader comments) is main text as it stands. Every other unmarked block, of pages with such
an element too, is main text but for what its host repeats; page order is kept. Pages with
the same article and unmarked text are one page for the repeats, so a page published under
two addresses of a host is not lost.

What a host repeats is found on the host's concatenated page token streams. Each suffix
of a stream is keyed by its first ``MIN_REPEAT`` tokens; sorting the suffixes by host and
key is the host's suffix array to that depth, and neighbours of equal key on distinct
pages are a long repeated substring. Any longer repeat is a union of such keys, so the
tokens covered by the keys are exactly the tokens of all substrings of that length or more
that repeat across distinct pages. The array is one Spark table over all hosts, reduced
per key by partial aggregates: a host with a third of all pages, or a line on all of them,
meets in no single task. The streams hold all visible blocks: text in menus, headers,
footers and articles is evidence, so a menu marked on one page is found where another page
leaves it unmarked, and so is the teaser of an article. Suffixes that no unmarked token
shares cannot decide anything; most of them are left out by a bit table of the keys that
can.

Defined cases: null html is empty and gives empty text; a null or unparsable url gives the
empty host; rows equal in page_id, url and html are one page for the repeats and keep one
row each; an unclosed tag ends the page; unknown references stay as they are; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundwise.llm.shared import cut, slices

MIN_REPEAT = 8
ASKED_BITS = 27
# Element names and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style textarea title xmp iframe noembed noframes noscript template form button select option input dialog svg canvas object audio video map math".split())
MARKED = frozenset("nav header footer aside menu".split())
MAIN = frozenset("article main".split())
SCOPES = frozenset("html body div section article main nav header footer aside form table td th ul ol dl blockquote figure details fieldset".split())
JUNK = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|banners?|sponsor(?:ed|s)?|promos?|promotions?|cookies?|consent|gdpr|notices?|alerts?|sidebars?|navs?|navbars?|navigation|menus?|"
    r"breadcrumbs?|footers?|masthead|comments?|commentlist|replies|disqus|share|sharing|social|related|recommend(?:ed|ations)?|newsletter|subscribe|subscription|popups?|modals?|overlay|signup|login|paywall|"
    r"copyright|disclaimer|toolbar|pagination|pager|widgets?|hidden|skip-?links?|complementary|contentinfo|search|alertdialog|dialog)(?:$|[\s_-]|\d)"
)
PAGE_HEADER = re.compile(r"(?:^|[\s_-])(?:page-header|site-header|header|banner)(?:$|[\s_-]|\d)")
# a quote opens a value behind "=" only; where the value never ends, the first ">" ends the tag
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>|</?[a-zA-Z][^>]*>""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""\s(?:hidden(?=[\s/>=])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
NOTHING, SOFT, PLAIN, ARTICLE = 0, 1, 2, 3


def pieces(page: str) -> Iterator[tuple[str, str]]:
    """(kind, content) pieces of a page: text, or a tag; an unclosed tag ends the page."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:]
            return
        if lt > at:
            yield "text", page[at:lt]
        m = TAG.match(page, lt)
        if not m:
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/" and lt + 2 < n and page[lt + 2].isalpha()):
                return
            yield "text", "<"
            at = lt + 1
            continue
        at = m.end()
        tag = m[0]
        if tag[1] in "!?":
            continue
        yield "tag", tag
        name = NAME.match(tag)[1].lower()
        if tag[1] != "/" and name in RAW and not tag.endswith("/>"):
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            yield "tag", f"</{name}>"
            at = close.end() if close else n


def state_of(name: str, tag: str, above: int, in_article: bool) -> int:
    """What the text of an element counts as, from its name, attributes and parent."""
    if above == NOTHING or name in NEVER or HIDDEN.search(tag):
        return NOTHING
    words = " ".join(v.strip("\"'").lower() for _, v in ATTRIBUTE.findall(tag)) if " " in tag else ""
    junk = bool(words) and name not in ("html", "body") and (JUNK.search(words) or not in_article and PAGE_HEADER.search(words))
    if junk:
        return NOTHING if in_article else SOFT
    if name in MAIN or "role" in tag and words and re.search(r"(?:^|\s)(?:main|article)(?:$|\s)", words):
        return above if above == SOFT else ARTICLE
    if name in MARKED and not (name == "header" and in_article):
        return NOTHING if in_article else SOFT
    return above


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(state, text) blocks of visible text in page order; white space is collapsed."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    state = PLAIN

    def close_block() -> None:
        if held:
            text = " ".join(markup.unescape("".join(held)).split())
            held.clear()
            if text and state != NOTHING:
                out.append((state, text))

    for kind, content in pieces(page or ""):
        if kind == "text":
            if state != NOTHING:
                held.append(content)
            continue
        name = NAME.match(content)[1].lower()
        if content[1] == "/":
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name not in INLINE or stack[depth][1] != (stack[depth - 1][1] if depth else PLAIN):
                        close_block()
                    del stack[depth:]
                    break
                if stack[depth][0] in SCOPES and name not in SCOPES:
                    break
            if name not in INLINE:
                close_block()
            state = stack[-1][1] if stack else PLAIN
            continue
        if name not in INLINE:
            close_block()
        if name in VOID:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name not in INLINE:
            # a new block ends an open paragraph, a new item the item before it
            ends = {"p", name} if name in ("li", "dt", "dd", "tr", "td", "th", "option") else {"p"}
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends:
                    del stack[depth:]
                    break
                if stack[depth][0] in SCOPES:
                    break
            state = stack[-1][1] if stack else PLAIN
        if content.endswith("/>") and name in ("svg", "math", "path"):
            continue
        new = state_of(name, content, state, state == ARTICLE)
        if new != state:
            close_block()
        stack.append((name, new))
        state = new
    close_block()
    return out


def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pages to rows with their streams: state and text of all visible blocks."""
    for rows in slices(batches, 128):
        keys, bodies, states, texts = [], [], [], []
        for page_id, url, page in zip(rows["page_id"], rows["url"], rows["html"], strict=True):
            found = blocks(page)
            keys.append(xxhash.xxh64_intdigest(f"{page_id}\0{url}\0{page}") - (1 << 63))
            bodies.append(xxhash.xxh64_intdigest(" ".join(t for s, t in found if s != SOFT)) - (1 << 63))
            states.append([s for s, _ in found])
            texts.append([t for _, t in found])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["page_id"], pa.int64()), pa.array(rows["url"], pa.string()), pa.array(keys, pa.int64()), pa.array(bodies, pa.int64()), pa.array(states, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))],
            ["page_id", "url", "page", "body", "states", "texts"],
        )


PARSED = "page_id long, url string, page long, body long, states array<int>, texts array<string>"
SUFFIXES = "host string, page long, body long, key long, place int"


def asked_place(host: str, keys: np.ndarray) -> np.ndarray:
    """Places of a host's keys in the bit table."""
    return ((keys ^ np.uint64(xxhash.xxh64_intdigest(host))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ASKED_BITS)


def suffix_keys(min_repeat: int, asked=None):
    """Keys of the suffixes of a page's stream: hash of the first ``min_repeat`` tokens.

    Without ``asked`` those that reach an unmarked token, with it (a broadcast bit table)
    all those that it may hold.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 128):
            hosts, pages, bodies, keys, places = [], [], [], [], []
            for host, page, body, states, texts in zip(rows["host"], rows["page"], rows["body"], rows["states"], rows["texts"], strict=True):
                tokens = [(s == PLAIN, w) for s, t in zip(states, texts, strict=True) for w in t.split()]
                n = len(tokens) - min_repeat + 1
                if n <= 0:
                    continue
                hashes = np.array([xxhash.xxh64_intdigest(w) for _, w in tokens], np.uint64)
                key = np.zeros(n, np.uint64)
                for i in range(min_repeat):
                    key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[i : i + n] + (key >> np.uint64(29)))
                if asked is None:
                    unmarked = np.concatenate([[0], np.cumsum([u for u, _ in tokens])])
                    place = np.flatnonzero(unmarked[min_repeat:] > unmarked[:n])
                else:
                    at = asked_place(host, key)
                    place = np.flatnonzero(asked.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
                hosts += [host] * len(place)
                pages += [page] * len(place)
                bodies += [body] * len(place)
                keys.append(key[place].view(np.int64))
                places.append(place.astype(np.int32))
            if hosts:
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(bodies, pa.int64()), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], ["host", "page", "body", "key", "place"])

    return run


def asked_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the table that the keys of suffixes set, as (word, bit)."""
    for rows in slices(batches, 1 << 14):
        at = np.array([int(asked_place(h, np.array([k], np.int64).view(np.uint64))[0]) for h, k in zip(rows["host"], rows["key"], strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])


def covered(states: list[int], texts: list[str], places: Iterable[int], min_repeat: int) -> str:
    """The article text of a page and its unmarked text outside the repeated substrings
    that start at ``places``."""
    tokens = [(s, w) for s, t in zip(states, texts, strict=True) for w in t.split()]
    gone = np.zeros(len(tokens) + 1, np.int32)
    for p in places:
        gone[p] += 1
        gone[min(len(tokens), p + min_repeat)] -= 1
    gone = np.cumsum(gone)
    return " ".join(w for (s, w), g in zip(tokens, gone, strict=False) if s == ARTICLE or s == PLAIN and not g)


def has_unmarked(states: Column) -> Column:
    return F.array_contains(states, F.lit(PLAIN))


def host_repeats(parsed: DataFrame, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """(page, places): where repeated substrings start on each page that needs them."""
    spark = parsed.sparkSession
    streams = parsed.withColumn("host", F.coalesce(F.lower(F.parse_url("url", F.lit("HOST"))), F.lit(""))).select("host", "page", "body", "states", "texts")
    asked = cut(streams.filter(has_unmarked(F.col("states"))).mapInArrow(suffix_keys(min_repeat), SUFFIXES), "pages-asked")
    words = asked.select("host", "key").mapInArrow(asked_words, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (ASKED_BITS - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    suffixes = streams.mapInArrow(suffix_keys(min_repeat, spark.sparkContext.broadcast(bits)), SUFFIXES)
    repeated = suffixes.groupBy("host", "key").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a <> b").select("host", "key")
    return asked.join(repeated, ["host", "key"], "left_semi").groupBy("page").agg(F.collect_set("place").alias("places"))


def extract(pages: DataFrame, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    parsed = cut(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(parse, PARSED), "pages-parsed")
    repeats = host_repeats(parsed, min_repeat)

    @F.udf("string")
    def left_over(states, texts, places):
        return covered(states, texts, places or [], min_repeat)

    # pages without unmarked text have nothing to decide and need no join
    decided = has_unmarked(F.col("states"))
    article = F.array_join(F.filter("texts", lambda t, i: F.get("states", i) == ARTICLE), " ")
    marked = parsed.filter(~decided).select("page_id", "url", article.alias("text"))
    open_pages = parsed.filter(decided).join(repeats, "page", "left").select("page_id", "url", left_over("states", "texts", "places").alias("text"))
    return marked.unionByName(open_pages).withColumn("n_chars", F.char_length("text").cast("long"))
