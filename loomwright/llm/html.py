"""Main text of web pages: structure first, then a suffix array over each host.

A page becomes blocks of text in page order. A block inside <article> or
<main>, and outside of menus, asides, forms and the like, is proved content;
under a name that only partly sounds like boilerplate it is doubtful. Blocks
outside of all these are open, on a page with <article> or <main> as on one
without; so is what a form holds that wraps the page. Content in a part that
is never closed ends that part. For open and doubtful blocks the host decides:
the token streams of the host's pages, each ended by its own symbol, are put
in one suffix array (prefix doubling up to RUN tokens); a string of RUN tokens
that occurs in two pages of different text is boilerplate, and every token it
covers is removed from open blocks, which keep their unique runs. A doubtful
block goes if it is covered whole, and stays whole otherwise.

Pages are grouped by host. Pages of hosts over GROUP_BYTES are dealt into
blocks by a hash (see blocks.py); what a host repeats in one block its suffix
array there finds, and what it repeats over several is asked of shards:

1. Blocks send filled cells of a sketch of their windows of RUN tokens, each
   keyed by its host, and learn which cells another block fills too.
2. Windows estimated repeated go on, with 96 bits of hash and the digest of a
   text that holds them; a shard answers for each whether two texts hold it.

So a page gets the same text however its host is dealt. Page text is shuffled
once, compressed.

Defined results: null and empty html give an empty text; a page without a host
in its url is grouped with the others of none; equal pages (also under one id)
don't make each other boilerplate; a script or comment that breaks off ends at
the end of the page; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import blocks as B
from loomwright.llm import hashing as H

RUN = 8
GROUP_BYTES = 4 << 20
#: Most rows of large hosts that are broadcast; beyond, Spark joins as it likes.
HOSTS = 100_000
#: Cells of the sketch for each window, and bytes of html for each window, at least.
WIDTH = 16
WINDOW_BYTES = 8
TEXTS = "page_id long, url string, text string"

#: Fixed values of the markup language.
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
SKIPPED = frozenset("nav footer aside dialog menu button head template object svg math canvas audio video select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTENT = frozenset(("article", "main"))
IN_FORMS = frozenset(("label", "legend"))
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p dt figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class and id that tell of parts outside the text,
SIGNS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription sidebar aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead comment comments commentbox commentlist disqus pager pagination reviews respond replies reply related share sharing social login signup search".split()
)
#: words that may tell of readers' talk or of the text's own part,
DOUBTS = frozenset(("discussion", "talk"))
#: and words that say nothing beside the signs. A name with any other word (market-share, related-work) is a doubtful sign.
NEUTRAL = frozenset(
    "area article articles author avatar bar block blog body bottom box btn button center col column container content count date desktop entry field fixed form global google group header heading holder icon icons inline inner input item items js left "
    "link links list main meta mobile module more native outer page panel post posts primary reader right row secondary section site slot small sticky text the thread title top unit user wp wrap wrapper".split()
)

#: A start or end tag whose attributes follow the language's grammar: a quote opens a value only right after `=`.
TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?=[^A-Za-z]))[^>]*(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
#: Places of a block; a doubtful one is content unless the host repeats it whole.
OUTSIDE, OPEN, PROVED, DOUBTFUL, FORM = range(5)
#: A form is the page's wrapper if it holds so many times the words that are outside of it.
WRAPS = 4


def _sign(own: dict[str, str], tag: str) -> int:
    """2 for a name of class or id that tells of a part outside the text, 1 for a doubtful one. The id of a heading or paragraph tells what it is about."""
    most = 0
    for name in (own.get("class", "") + " " + (own.get("id", "") if tag not in ANCHORED else "")).split():
        words = {w.lower() for w in WORDS.findall(html.unescape(name))}
        if not DOUBTS.isdisjoint(words):
            most = max(most, 1)
        if not SIGNS.isdisjoint(words):
            most = max(most, 2 if words <= SIGNS | NEUTRAL else 1)
    return most


def _kind(tag: str, attributes: str, state: int) -> int | None:
    """The place that an element gives to what it holds; None: that of its parent."""
    own = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    if own and ("hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I)):
        return OUTSIDE
    role = own.get("role", "").lower()
    if tag in SKIPPED or role in ROLES or tag in IN_FORMS and state == FORM or tag == "header" and state not in (PROVED, DOUBTFUL):
        return OUTSIDE
    sign = _sign(own, tag) if own else 0
    if tag in CONTENT or role in CONTENT:
        return OUTSIDE if sign == 2 and tag != "main" else PROVED
    if tag in ("body", "html"):
        return None
    if sign == 2:
        return OUTSIDE
    if tag == "form":
        return FORM
    return DOUBTFUL if sign else None


class Open:
    """An open element that gives a place: how many of its tag are open in it, blocks that its own end tag would put outside, and a line's text before it."""

    __slots__ = ("tag", "depth", "place", "doubted", "held")

    def __init__(self, tag: str, place: int, held: list[str] | None):
        self.tag, self.depth, self.place, self.doubted, self.held = tag, 1, place, [], held


def blocks(page: str | None) -> list[tuple[str, int]]:
    """Each block's text (references decoded, white space single) and its place."""
    texts: list[str] = []
    places: list[int] = []
    text: list[str] = []
    page = page or ""
    at = 0
    stack: list[Open] = []
    by_tag: dict[str, list[int]] = {}
    skips: list[int] = []  # of the stack, those that put outside

    def flush():
        flush_as(stack[-1].place if stack else OPEN)

    def flush_as(place: int):
        nonlocal text
        words = html.unescape("".join(text)).split()
        if words:
            if place != OUTSIDE and skips:  # content in a part outside: if that never ends by itself, it ended where the content began
                stack[skips[-1]].doubted.append(len(texts))
            texts.append(" ".join(words))
            places.append(place)
        text = []

    def push(tag: str, place: int, held: list[str] | None):
        if place == OUTSIDE:
            skips.append(len(stack))
        by_tag.setdefault(tag, []).append(len(stack))
        stack.append(Open(tag, place, held))

    def pop(explicit: bool):
        nonlocal text
        top = stack.pop()
        if top.held is not None:
            flush_as(OUTSIDE)
            text = top.held
        by_tag[top.tag].pop()
        if top.place == OUTSIDE:
            skips.pop()
            if explicit:
                for k in top.doubted:
                    places[k] = OUTSIDE
            elif skips:
                stack[skips[-1]].doubted += top.doubted

    while m := TAG.search(page, at):
        text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if end or tag in ("script", "style"):
                    at = end.end() if end else len(page)
            continue
        if tag == "br":
            text.append(" ")
        own = by_tag.get(tag)
        if closing:
            if tag not in INLINE:
                flush()
                if stack and stack[-1].tag == "p" and tag != "p":
                    pop(True)
                    own = by_tag.get(tag)
            if tag in ("body", "html"):
                while stack:
                    pop(False)
            elif own:
                stack[own[-1]].depth -= 1
                if not stack[own[-1]].depth:
                    last = own[-1]
                    if tag not in INLINE:
                        flush()
                    while len(stack) > last + 1:
                        pop(False)
                    pop(True)
            continue
        if tag not in INLINE:
            flush()
            if stack and stack[-1].tag == "p":  # a paragraph ends where a block begins
                pop(True)
                own = by_tag.get(tag)
        if tag in VOID or SELF_CLOSED.search(m[3]):
            continue
        state = stack[-1].place if stack else OPEN
        kind = _kind(tag, m[3], state)
        inside = state in (PROVED, DOUBTFUL)
        if kind is None or kind == state or kind != OUTSIDE and tag in INLINE or kind == PROVED and inside or kind == FORM and state == OUTSIDE or kind == DOUBTFUL and state != PROVED:
            if own:
                stack[own[-1]].depth += 1
        else:
            held = text if tag in INLINE else None
            text = []
            push(tag, kind, held)
    text.append(page[at:])
    flush()
    while stack:
        pop(False)
        flush()
    sizes = [t.count(" ") + 1 for t in texts]
    held = sum(n for n, p in zip(sizes, places, strict=True) if p == FORM)
    wraps = held >= WRAPS * sum(n for n, p in zip(sizes, places, strict=True) if p not in (FORM, OUTSIDE))
    return [(t, p if p != FORM else OPEN if wraps else OUTSIDE) for t, p in zip(texts, places, strict=True)]


def repeated(streams: list[list[str]], run: int = RUN) -> list[np.ndarray]:
    """For each page's tokens, which are covered by a string of `run` tokens that occurs in two pages of different tokens."""
    number: dict[str, int] = {}
    owners: dict[tuple, int] = {}
    owner_of = [owners.setdefault(tuple(s), len(owners)) for s in streams]
    distinct = list(owners)
    flat = [np.array([number.setdefault(t, len(number)) for t in s], np.int64) for s in distinct]
    sizes = np.array([len(s) + 1 for s in flat])
    rank = np.concatenate([np.append(s, 0) for s in flat]) + len(flat)
    ends = np.cumsum(sizes) - 1
    rank[ends] = np.arange(len(flat))  # each page's own end
    n, step = len(rank), 1
    page = np.repeat(np.arange(len(flat)), sizes)
    order = np.argsort(rank, kind="stable")
    while step < run:  # the suffix array by its first 2, 4, 8, ... tokens; the last step may overlap
        shift = min(step, run - step)
        key = np.zeros(n, np.int64)
        key[: max(n - shift, 0)] = rank[shift:] + 1
        key += rank * np.int64(n + len(number) + len(flat) + 2)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank[order] = np.cumsum(new)
        step += shift
    same = np.zeros(n, bool)
    head = rank[order]
    begin = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    low, high = np.minimum.reduceat(page[order], begin), np.maximum.reduceat(page[order], begin)
    same[order] = np.repeat(low != high, np.diff(begin, append=n))
    at = np.flatnonzero(same)
    delta = np.zeros(n + run + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + run, -1)
    covered = np.cumsum(delta)[:n] > 0
    parts = np.split(covered, np.cumsum(sizes)[:-1])
    return [parts[o][:-1] for o in owner_of]


def is_open(page: list[tuple[str, int]]) -> bool:
    return any(place in (OPEN, DOUBTFUL) for _, place in page)


def kept_text(page: list[tuple[str, int]], gone: np.ndarray | None) -> str:
    """A page's content, what is not gone of its open blocks, and doubtful ones that aren't gone whole."""
    at, kept = 0, []
    for text, place in page:
        n = text.count(" ") + 1
        if place == OPEN:
            text = " ".join(t for t, g in zip(text.split(" "), gone[at : at + n], strict=True) if not g)
        elif place == DOUBTFUL and gone[at : at + n].all():
            text = ""
        if place and text:
            kept.append(text)
        at += n
    return "\n".join(kept)


def covers(pages: list[list[tuple[str, int]]], run: int = RUN) -> list[np.ndarray | None]:
    """What the pages of a host repeat; not asked (None) where no page has an open block."""
    if not any(map(is_open, pages)):
        return [None] * len(pages)
    return repeated([[t for text, _ in page for t in text.split(" ")] for page in pages], run)


def main_texts(pages: list[list[tuple[str, int]]], run: int = RUN) -> list[str]:
    """The texts of a host's pages from their blocks."""
    return [kept_text(page, gone) for page, gone in zip(pages, covers(pages, run), strict=True)]


def _digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


def _unpacked(table: pa.Table) -> list[list[tuple[str, int]]]:
    read = zstandard.ZstdDecompressor()
    return [json.loads(read.decompress(x)) for x in table.column("body").to_pylist()]


def _texts(table: pa.Table, texts: list[str]) -> pa.Table:
    done = [t.encode("utf-8", "replace").decode() for t in texts]
    return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(done, pa.string())})


class Windows:
    """The windows of RUN tokens of a block's distinct texts of each host: text, place in it, 64 + 32 bits of hash keyed by host."""

    def __init__(self, table: pa.Table, shards: int, cells: int):
        self.pages, self.hosts, self.shards = _unpacked(table), table.column("host").to_pylist(), shards
        whole = [(h, " ".join(t for t, _ in p).encode("utf-8", "surrogatepass")) for h, p in zip(self.hosts, self.pages, strict=True)]
        distinct = sorted(set(whole))
        number = {x: k for k, x in enumerate(distinct)}
        self.text_of_page = [number[x] for x in whole]
        self.digest = np.array([_digest(t) for _, t in distinct], np.uint64)
        host = np.array([_digest(h.encode("utf-8", "surrogatepass")) for h, _ in distinct], np.uint64)
        text_of, place, h1, h2 = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
        for first, _, data, offsets in H.chunks([t for _, t in distinct]):
            starts, ends, owner = H.words(data, offsets)
            if not len(starts):
                continue
            at, a, b = H.word_windows(H.word_hashes(data, starts, ends), owner, RUN, wide=True)
            mine = host[owner[at] + first]
            text_of.append(owner[at] + first)
            place.append(at - np.searchsorted(owner, owner[at]))
            h1.append(H.mix(a + mine, 90))
            h2.append(b ^ H.mix(mine, 91).astype(np.uint32))
        self.text_of, self.place, self.h1, self.h2 = (np.concatenate(x) for x in (text_of, place, h1, h2))
        self.cell = H.mix(self.h1, 92) % np.uint64(cells * shards)
        self.full, counts = np.unique(self.cell, return_counts=True)
        self.twice = counts > 1
        self.shard = (self.full // np.uint64(cells)).astype(np.int32)

    def exact(self, back: pa.Table):
        """The windows estimated repeated, and the distinct ones of them, sorted by shard and hash: shard, h1, h2, least digest, if two texts hold it here; and of which entry each window is."""
        cells = self.twice | B.read_bits(back, "cells", self.shard, self.shards)
        some = np.flatnonzero(cells[np.searchsorted(self.full, self.cell)])
        h1, h2, digest = self.h1[some], self.h2[some], self.digest[self.text_of[some]]
        shard = (h1 % np.uint64(self.shards)).astype(np.int32)
        order = np.lexsort((digest, h2, h1, shard))
        s, a, b, d = shard[order], h1[order], h2[order], digest[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        last = np.ones(len(a), bool)
        last[:-1] = new[1:]
        entry = np.empty(len(a), np.int64)
        entry[order] = np.cumsum(new) - 1
        return some, s[new], a[new], b[new], d[new], d[new] != d[last], entry


def in_two_texts(lists: dict[int, tuple[np.ndarray, ...]]) -> dict[int, np.ndarray]:
    """For each block's entries (h1, h2, digest, if two texts hold it there): whether two texts hold it at all."""
    h1, h2, digest, two = (np.concatenate([x[k] for x in lists.values()]) for k in range(4))
    order = np.lexsort((h2, h1))
    a, b, d = h1[order], h2[order], digest[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(new)
    found = (np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)) | np.logical_or.reduceat(two[order], begin)
    out = np.empty(len(a), bool)
    out[order] = found[np.cumsum(new) - 1]
    return dict(zip(lists, np.split(out, np.cumsum([len(x[0]) for x in lists.values()])[:-1]), strict=True))


def dealt_texts(d: DataFrame, shards: int, cells: int) -> DataFrame:
    """page_id, url and text of the pages (host, block, page_id, url, body) of hosts that are dealt into blocks."""

    def sketch(block, table):
        mine = Windows(table, shards, cells)
        return B.sent(block, shards, mine.shard, cells=lambda k: B.pack_sorted(mine.full[k] % np.uint64(cells)))

    def merge(shard, table):
        return B.bits_back(shard, "cells", B.in_several({b: B.unpack_sorted(x["cells"]) for b, x in B.by_block(table).items()}))

    def exact(block, table, back):
        _, shard, h1, h2, digest, two, _ = Windows(table, shards, cells).exact(back)
        return B.sent(block, shards, shard, h1=lambda k: B.pack_sorted(h1[k]), h2=lambda k: B.pack(h2[k]), digest=lambda k: B.pack(digest[k]), two=lambda k: B.pack(two[k].view(np.uint8)))

    def group(shard, table):
        lists = {b: (B.unpack_sorted(x["h1"]), B.unpack(x["h2"]), B.unpack(x["digest"]), B.unpack(x["two"]).astype(bool)) for b, x in B.by_block(table).items()}
        return B.bits_back(shard, "repeated", in_two_texts(lists))

    def keep(block, table, back):
        pages, hosts = _unpacked(table), table.column("host").to_pylist()
        if not any(map(is_open, pages)):
            return _texts(table, [kept_text(p, None) for p in pages])
        mine = Windows(table, shards, cells)
        some, shard, *_, entry = mine.exact(back)
        starts = some[B.read_bits(back, "repeated", shard, shards)[entry]]
        by_text = np.searchsorted(mine.text_of[starts], np.arange(len(mine.digest) + 1))
        local: list[np.ndarray | None] = [None] * len(pages)
        by_host: dict[str, list[int]] = {}
        for k, h in enumerate(hosts):
            by_host.setdefault(h, []).append(k)
        for rows in by_host.values():
            for k, gone in zip(rows, covers([pages[k] for k in rows]), strict=True):
                local[k] = gone
        out = []
        for k, page in enumerate(pages):
            gone, t = local[k], mine.text_of_page[k]
            if gone is not None:
                gone = gone | H.covered(mine.place[starts[by_text[t] : by_text[t + 1]]], RUN, len(gone))
            out.append(kept_text(page, gone))
        return _texts(table, out)

    first = B.answer(B.ask(d, B.SENT, sketch), merge)
    second = B.answer(B.ask_again(d, first, B.SENT, exact), group)

    return B.ask_again(d, first.unionByName(second), TEXTS, keep)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url and text of each page."""
    one = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"))
    one = one.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    large = one.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes")).where(F.col("bytes") > GROUP_BYTES)
    found = large.limit(HOSTS + 1).collect()
    total = sum(r["bytes"] for r in found)
    if len(found) <= HOSTS:
        large = F.broadcast(pages.sparkSession.createDataFrame(found, large.schema))
    else:
        total = large.agg(F.sum("bytes").alias("n")).first()["n"]

    def parse(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                body = [pack.compress(json.dumps(blocks(h), ensure_ascii=False).encode("utf-8", "surrogatepass")) for h in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("host", "block", "page_id", "url")), pa.array(body, pa.binary())], names=["host", "block", "page_id", "url", "body"])

    def texts(table):
        return _texts(table, main_texts(_unpacked(table)))

    parsed = "host string, block int, page_id long, url string, body binary"
    small = one if not found else one.join(large, "host", "left_anti")
    out = small.withColumn("block", F.lit(0)).mapInArrow(parse, parsed).groupBy("host").applyInArrow(texts, TEXTS)
    if not found:
        return out
    n = B.blocks_for(total)
    d = one.join(large, "host", "left_semi").withColumn("block", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(n)).cast("int")).mapInArrow(parse, parsed)
    return out.unionByName(dealt_texts(d, n, max(1 << 10, WIDTH * (total // (WINDOW_BYTES * n) + 1))))
