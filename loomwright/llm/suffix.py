"""Removal of repeated byte strings, by threshold-bounded interval expansion on a BWT.

Equal strings of `length` bytes share their minimizer (the least hash among
their GRAM-byte substrings), so the corpus is cut into *segments*: maximal runs
of windows with one minimizer. A segment goes to the shard of its minimizer,
where all windows that could equal one of its own are.

1. Each block sends its distinct minimizers as packed 40-bit cells and learns
   which ones another block has. Segments whose minimizer no second document
   has are done: none of their windows is repeated.
2. Each block sends its other segments, equal ones once with the least doc_id.
   A shard concatenates the distinct segments, builds the suffix array and the
   Burrows-Wheeler transform, and extends intervals backward breadth first:
   level l sets the boundaries whose common prefix has l bytes, so values come
   in increasing order, and expansion stops at `length`. Suffixes between two
   set boundaries then share at least `length` bytes. Each such group's least
   doc_id answers one bit for each window of each segment.

Shards sort at most RUN_BYTES of segments at a time, whole minimizers together.
A minimizer whose segments are one text needs no sorting: its windows differ
only by place. A minimizer with over HOT segments in the corpus (a phrase in
many contexts) would be one shard's load, so its windows go by themselves, each
to the shard of its own 128-bit hash, equal ones of a block once.

Defined results: null text is empty; texts under `length` bytes lose nothing; a
string repeated inside one document only stays; equal doc_ids don't remove
from one another; a null doc_id counts as the largest; other columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwright.llm import blocks as B
from loomwright.llm import hashing as H

#: Bytes of a minimizer.
GRAM = 20
CELL_BITS = np.uint64(40)
RUN_BYTES = 1 << 20
#: Segments of a minimizer (of twice the length less one bytes at most), over all blocks, from which its windows are dealt out.
HOT = 200_000
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """First window, number of windows, key and text number of each segment of a chunk."""
    last = len(data) - length + 1
    if last <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), np.empty(0, np.int64))
    keys = H.mix(H.sliding(data.astype(np.uint64) + np.uint64(1), gram), 3)
    width = length - gram + 1
    least = H.sliding_min(keys, width)[:last]
    whole = np.ones(last, bool)  # windows that end before their text's last newline
    for end in offsets[1:]:
        whole[max(0, end - length) : end] = False
    text_of = np.searchsorted(offsets, np.arange(last), "right") - 1 if len(offsets) > 2 else np.zeros(last, np.int64)
    new = np.ones(last, bool)
    new[1:] = (least[1:] != least[:-1]) | (text_of[1:] != text_of[:-1])
    new[1:] |= whole[1:] != whole[:-1]
    # a periodic text may keep one minimum for long; cut there, so that a segment has at most 2 * length bytes
    begin = np.flatnonzero(new)
    size = np.diff(begin, append=last)
    if (size > length).any():
        extra = np.concatenate([np.arange(b + length, b + s, length) for b, s in zip(begin[size > length], size[size > length], strict=True)])
        new[extra] = True
        begin = np.flatnonzero(new)
        size = np.diff(begin, append=last)
    good = whole[begin]
    begin, size = begin[good], size[good]
    return begin, size, least[begin], text_of[begin]


class Block:
    """A block's segments: text, place, windows, key."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.ids, self.texts = B.ids_and_texts(table)
        parts = []
        for first, _, data, offsets in H.chunks(self.texts):
            begin, size, key, text = segments(data, offsets, length, gram)
            parts.append((begin - offsets[text], size, key, text + first))
        cat = lambda k, kind: np.concatenate([p[k] for p in parts]).astype(kind) if parts else np.empty(0, kind)
        self.place, self.size, self.key, self.text_of = cat(0, np.int32), cat(1, np.int32), cat(2, np.uint64), cat(3, np.int32)

    def cells(self, shards: int):
        """Distinct (shard, cell) numbers, sorted; which of them two of this block's documents have; segments in each; the entry of each segment."""
        cell = ((self.key % np.uint64(shards)) << CELL_BITS) | (self.key >> np.uint64(64 - int(CELL_BITS)))
        full, entry = np.unique(cell, return_inverse=True)
        low, high = np.full(len(full), B.NO_ID), np.full(len(full), np.iinfo(np.int64).min)
        ids = self.ids[self.text_of]
        np.minimum.at(low, entry, ids)
        np.maximum.at(high, entry, ids)
        return full, low != high, np.bincount(entry, minlength=len(full)), entry

    def chosen(self, back: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Segments whose key is repeated, and those among them whose key is hot."""
        full, local, _, entry = self.cells(shards)
        shard = (full >> CELL_BITS).astype(np.int32)
        shared, hot = local | B.read_bits(back, "seen", shard, shards), B.read_bits(back, "hot", shard, shards)
        return np.flatnonzero((shared & ~hot)[entry]), np.flatnonzero((shared & hot)[entry])

    def candidates(self, chosen: np.ndarray, shards: int, length: int):
        """Of the chosen segments, equal ones once: shard, key, bytes, windows, least id of each, and the one of each segment."""
        distinct: dict[tuple[int, bytes], list] = {}
        slot = np.empty(len(chosen), np.int64)
        for n, (t, p, s, k) in enumerate(zip(self.text_of[chosen].tolist(), self.place[chosen].tolist(), self.size[chosen].tolist(), self.key[chosen].tolist(), strict=True)):
            found = distinct.setdefault((k, self.texts[t][p : p + s + length - 1]), [len(distinct), s, self.ids[t]])  # texts are in order of ids
            slot[n] = found[0]
        keys = np.array([k for k, _ in distinct], np.uint64)
        body = [x for _, x in distinct]
        size, ids = (np.array([v[j] for v in distinct.values()], np.int64) for j in (1, 2))
        order = np.lexsort((keys, keys % np.uint64(shards))) if len(keys) else np.empty(0, np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank[slot], (keys[order] % np.uint64(shards)).astype(np.int32), keys[order], [body[k] for k in order], size[order], ids[order]

    def windows(self, chosen: np.ndarray, shards: int, length: int):
        """Of the chosen segments' windows, equal ones once, sorted by shard and hash: shard, two hashes, least id; and the text, the place and the one of each window."""
        text = np.repeat(self.text_of[chosen], self.size[chosen])
        ends = np.cumsum(self.size[chosen])
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - self.size[chosen], self.size[chosen]) + np.repeat(self.place[chosen], self.size[chosen])
        a, b = np.empty(len(text), np.uint64), np.empty(len(text), np.uint64)
        begin = 0
        for t, n in zip(*np.unique(text, return_counts=True), strict=True):  # texts of segments are in order
            data = np.frombuffer(self.texts[t], np.uint8).astype(np.uint64) + np.uint64(1)
            at = place[begin : begin + n]
            for first in range(0, len(data), H.CHUNK_BYTES):
                mine = np.flatnonzero((at >= first) & (at < first + H.CHUNK_BYTES))
                if len(mine):
                    part = data[first : first + H.CHUNK_BYTES + length]
                    a[begin + mine] = H.mix(H.sliding(part, length)[at[mine] - first], 4)
                    b[begin + mine] = H.mix(H.sliding(H.mix(part, 5), length, H._B)[at[mine] - first], 6)
            begin += n
        shard = (a % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((self.ids[text], b, a, shard))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        slot = np.empty(len(order), np.int64)
        slot[order] = np.cumsum(new) - 1
        first = order[new]
        return shard[first], a[first], b[first], self.ids[text[first]], text, place, slot


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse of distinct-ended symbols, by prefix doubling."""
    n = len(text)
    rank, most = text.astype(np.int64), int(text.max())
    step, together = 1, 62 // (most + 2).bit_length()
    while True:
        key = np.zeros(n, np.int64)
        if step == 1:  # as many symbols as a number holds
            step = min(max(2, together), n)
            for k in range(step):
                key *= most + 2
                key[: n - k] += rank[k:] + 1
        else:
            key[: n - step] = rank[step:] + 1
            key += rank * np.int64(n + 1)
            step *= 2
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = ordered[1:] != ordered[:-1]
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            return order, rank


def bounded_boundaries(order: np.ndarray, rank: np.ndarray, text: np.ndarray, limit: int) -> np.ndarray:
    """Which places of the suffix array begin a run of suffixes that share `limit` symbols.

    Breadth-first backward extension: `first` and `last` are the intervals of
    the strings of the current length. Extending by each symbol before the
    suffixes of an interval gives the intervals one longer; one whose end is
    already a boundary of a shorter common prefix isn't followed.
    """
    n = len(order)
    before = text[order - 1]  # the transform; cyclic for the suffix at 0
    back = rank[order - 1]
    by_symbol = np.empty(n, np.int64)
    by_symbol[back] = np.arange(n)  # equal symbols stand together, in the order of their suffixes
    later, earlier = np.full(n, n), np.full(n, -1)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    later[by_symbol[:-1][same]] = by_symbol[1:][same]
    earlier[by_symbol[1:][same]] = by_symbol[:-1][same]
    is_boundary = np.zeros(n + 1, bool)
    is_boundary[[0, n]] = True
    first, last = np.array([0]), np.array([n - 1])
    for _ in range(limit):
        size = last - first + 1
        if not len(size):
            break
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(first, size)
        final = at[later[at] > np.repeat(last, size)]
        initial = at[earlier[at] < np.repeat(first, size)]
        # LF keeps the order of equal symbols, so the sorted ends pair up with the sorted starts
        lo, hi = np.sort(back[initial]), np.sort(back[final])
        fresh = ~is_boundary[hi + 1]
        first, last = lo[fresh], hi[fresh]
        is_boundary[last + 1] = True
    return is_boundary[:-1]


def least_owner(bodies: list[bytes], sizes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each window of each segment (concatenated), the least id of a segment that has an equal window."""
    lengths = np.array([len(x) for x in bodies])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) + len(bodies)
    text[starts + lengths] = np.arange(len(bodies))  # separators, each its own symbol
    order, rank = suffix_array(text)
    group = np.cumsum(bounded_boundaries(order, rank, text, length)) - 1
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    at = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)
    mine = group[rank[at]]
    owner = np.repeat(ids, sizes)
    least = np.full(int(group[-1]) + 1, B.NO_ID)
    np.minimum.at(least, mine, owner)
    return least[mine]


def remove_repeated_strings(docs: DataFrame, length: int = 50, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's bytes without those covered by a string of `length` bytes that also starts in a document of smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256.
    """
    shards, _ = B.count_blocks(docs, text)
    d = B.into_blocks(docs, shards, doc_id, text)
    mask = np.uint64((1 << int(CELL_BITS)) - 1)

    def keys(block, table):
        full, _, count, _ = Block(table, length, gram).cells(shards)
        return B.sent(block, shards, (full >> CELL_BITS).astype(np.int32), cells=lambda k: B.pack_sorted(full[k] & mask), count=lambda k: B.pack(count[k].astype(np.uint32)))

    def merge(shard, table):
        lists = {b: (B.unpack_sorted(x["cells"]), B.unpack(x["count"]).astype(np.int64)) for b, x in B.by_block(table).items()}
        cell, entry = np.unique(np.concatenate([c for c, _ in lists.values()]), return_inverse=True)
        many = np.bincount(entry, weights=np.concatenate([n for _, n in lists.values()]), minlength=len(cell)) > HOT
        hot = dict(zip(lists, np.split(many[entry], np.cumsum([len(c) for c, _ in lists.values()])[:-1]), strict=True))
        return pa.concat_tables([B.bits_back(shard, "seen", B.in_several({b: c for b, (c, _) in lists.items()})), B.bits_back(shard, "hot", hot)])

    def send(block, table, back):
        mine = Block(table, length, gram)
        usual, hot = mine.chosen(back, shards)
        _, shard, key, body, size, ids = mine.candidates(usual, shards, length)
        lengths = np.array([len(x) for x in body], np.uint32)
        out = B.sent(
            block, shards, shard,
            key=lambda k: B.pack_sorted(key[k]), body=lambda k: B.pack(np.frombuffer(b"".join(body[k]), np.uint8)),
            length=lambda k: B.pack(lengths[k]), id=lambda k: B.pack(ids[k].view(np.uint64)),
        )
        if not len(hot):
            return out
        window_shard, a, b, least, *_ = mine.windows(hot, shards, length)
        return pa.concat_tables([out, B.sent(block, shards, window_shard, a=lambda k: B.pack_sorted(a[k]), b=lambda k: B.pack(b[k]), least=lambda k: B.pack(least[k].view(np.uint64)))])

    def older_windows(shard, lists):
        """Of each block's hot windows, which an id below the block's least one has."""
        a, b, least = (np.concatenate([x[k] for x in lists.values()]) for k in range(3))
        order = np.lexsort((least, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        first = np.empty(len(order), np.int64)
        first[order] = least[order][new][np.cumsum(new) - 1]
        return B.bits_back(shard, "older_hot", dict(zip(lists, np.split(first < least, np.cumsum([len(x[0]) for x in lists.values()])[:-1]), strict=True)))

    def group(shard, table):
        distinct: dict[bytes, list[int]] = {}
        use: dict[int, np.ndarray] = {}
        got = B.by_block(table)
        hot = {b: (B.unpack_sorted(x["a"]), B.unpack(x["b"]), B.unpack(x["least"]).view(np.int64)) for b, x in got.items() if "a" in x}
        told = [older_windows(shard, hot)] if hot else []
        for b, x in got.items():
            if "key" not in x:
                continue
            key, lengths, ids, body = B.unpack_sorted(x["key"]), B.unpack(x["length"]), B.unpack(x["id"]).view(np.int64), B.unpack(x["body"]).tobytes()
            ends, mine = np.cumsum(lengths.astype(np.int64)).tolist(), []
            for k, e, n, i in zip(key.tolist(), ends, lengths.tolist(), ids.tolist(), strict=True):
                found = distinct.setdefault(body[e - n : e], [len(distinct), k, i])
                found[2] = min(found[2], i)
                mine.append(found[0])
            use[b] = (np.array(mine, np.int64), ids)
        if not use:
            return told[0]
        bodies = list(distinct)
        key, least = np.array([v[1] for v in distinct.values()], np.uint64), np.array([v[2] for v in distinct.values()], np.int64)
        size = np.array([len(x) - length + 1 for x in bodies], np.int64)
        ends = np.cumsum(size)
        owner = np.repeat(least, size)
        by_key = np.argsort(key, kind="stable")
        _, at, members = np.unique(key[by_key], return_index=True, return_counts=True)
        run, run_bytes = [], 0
        for k, m in [*((a, c) for a, c in zip(at.tolist(), members.tolist(), strict=True) if c > 1), (0, 0)]:
            if run and (not m or run_bytes > RUN_BYTES):
                found = least_owner([bodies[j] for j in run], size[run], least[run], length)
                owner[np.concatenate([np.arange(ends[j] - size[j], ends[j]) for j in run])] = found
                run, run_bytes = [], 0
            more = by_key[k : k + m].tolist()
            run += more
            run_bytes += sum(len(bodies[j]) for j in more)
        flags = {}
        for b, (mine, ids) in use.items():
            n = size[mine]
            e = np.cumsum(n)
            place = np.arange(int(e[-1])) - np.repeat(e - n, n) + np.repeat(ends[mine] - n, n)
            flags[b] = owner[place] < np.repeat(ids, n)
        return pa.concat_tables([B.bits_back(shard, "older", flags), *told])

    def keep(block, table, back):
        mine = Block(table, length, gram)
        chosen, hot = mine.chosen(back, shards)
        slot, shard, key, body, size, ids = mine.candidates(chosen, shards, length)
        windows = np.repeat(shard, size)
        older = B.read_bits(back, "older", windows, shards)
        ends = np.cumsum(size)
        text_of, place = mine.text_of[chosen], mine.place[chosen]
        n = size[slot]
        e = np.cumsum(n)
        inside = np.arange(int(e[-1]) if len(e) else 0) - np.repeat(e - n, n)
        bad = older[inside + np.repeat(ends[slot] - n, n)] | np.repeat(ids[slot] < mine.ids[text_of], n)
        bad_text, bad_place = np.repeat(text_of, n)[bad], (inside + np.repeat(place, n))[bad]
        if len(hot):
            window_shard, _, _, least, text, at, one = mine.windows(hot, shards, length)
            gone = B.read_bits(back, "older_hot", window_shard, shards)[one] | (least[one] < mine.ids[text])
            bad_text, bad_place = np.concatenate([bad_text, text[gone]]), np.concatenate([bad_place, at[gone]])
            order = np.argsort(bad_text, kind="stable")
            bad_text, bad_place = bad_text[order], bad_place[order]
        by_text = np.searchsorted(bad_text, np.arange(len(mine.ids) + 1))
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
        for i, t in enumerate(mine.texts):
            removed = spans = 0
            starts = bad_place[by_text[i] : by_text[i + 1]]
            kept = t
            if len(starts):
                gone = H.covered(starts, length, len(t))
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            for k, v in zip(out, (None if mine.ids[i] == B.NO_ID else int(mine.ids[i]), len(t), removed, spans, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                out[k].append(v)
        return B.rows(KEPT, **out)

    first = B.answer(B.ask(d, B.SENT, keys), merge)
    second = B.answer(B.ask_again(d, first, B.SENT, send), group)
    return B.ask_again(d, first.unionByName(second), KEPT, keep)
