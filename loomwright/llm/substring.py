"""Removal of repeated word windows, with a count-min prefilter.

Two passes over the same blocks (see blocks.py):

1. Each block makes a count-min sketch of its word windows: DEPTH rows of
   cells, saturated at two, sent sparsely (sorted cell numbers as packed
   differences) and merged by ranges of cells. The merged sketch estimates a
   window's count from above, so a window that occurs twice is never missed.
   A block learns for each of its cells whether another block filled it too.
2. Only windows estimated repeated go on, with 96 bits of hash and the least
   doc_id that holds them in their block; the exact grouping finds the least
   doc_id of all, and answers one bit for each.

The sketch's width follows the number of windows (WIDTH cells each, known
from one sum over the text lengths); nothing is broadcast, and no part of the
sketch is held by one task alone.

Defined results: null text has no words; empty texts and texts of fewer words
than a window lose nothing; a window repeated inside one document only is
kept; rows with equal doc_id don't remove from one another; a null doc_id
counts as the largest; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwright.llm import blocks as B
from loomwright.llm import hashing as H

DEPTH = 2
WIDTH = 8
KEPT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


@dataclass(frozen=True)
class Plan:
    """window: words. shards, cells: of the sketch's rows and of the exact grouping."""

    window: int
    shards: int
    cells: int


class Block:
    """A block's windows: text, position in it, 64 + 32 bits of hash."""

    def __init__(self, table: pa.Table, window: int, keep_words: bool = False):
        self.ids, self.texts = B.ids_and_texts(table)
        text_of, place, h1, h2 = [], [], [], []
        self.n_words = np.zeros(len(self.ids), np.int64)
        self.spans: list = []
        for first, _, data, offsets in H.chunks(self.texts):
            starts, ends, owner = H.words(data, offsets)
            if not len(starts):
                continue
            self.n_words[first : first + len(offsets) - 1] = np.bincount(owner, minlength=len(offsets) - 1)
            at, a, b = H.word_windows(H.word_hashes(data, starts, ends), owner, window, wide=True)
            begin = np.searchsorted(owner, owner[at])
            text_of.append((owner[at] + first).astype(np.int32))
            place.append((at - begin).astype(np.int32))
            h1.append(a)
            h2.append(b)
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.text_of, self.place, self.h1, self.h2 = cat(text_of, np.int32), cat(place, np.int32), cat(h1, np.uint64), cat(h2, np.uint32)

    def cells(self, row: int, plan: Plan) -> np.ndarray:
        return H.mix(self.h1, 20 + row) % np.uint64(plan.cells * plan.shards)

    def sketch(self, row: int, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """This row's filled cells, sorted; whether each has two windows here already; the cell of each window."""
        cells = self.cells(row, plan)
        full, counts = np.unique(cells, return_counts=True)
        return full, counts > 1, cells

    def exact(self, repeated: np.ndarray, plan: Plan):
        """Distinct windows among those estimated repeated, sorted by shard and hash: (shard, h1, h2, least id), and of which entry each window is."""
        h1, h2, ids = self.h1[repeated], self.h2[repeated], self.ids[self.text_of[repeated]]
        shard = (h1 % np.uint64(plan.shards)).astype(np.int32)
        order = np.lexsort((ids, h2, h1, shard))
        s, a, b, i = shard[order], h1[order], h2[order], ids[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        entry = np.empty(len(a), np.int64)
        entry[order] = np.cumsum(new) - 1
        return s[new], a[new], b[new], i[new], entry


def remove_repeated_windows(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's words without those covered by a window that also starts in a document of smaller id.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256.
    """
    n, total = B.count_blocks(docs, text)
    plan = Plan(window, n, max(1 << 10, WIDTH * (total // (5 * n) + 1)))
    d = B.into_blocks(docs, n, doc_id, text)

    def sketch(block, table):
        mine = Block(table, plan.window)
        out = []
        for row in range(DEPTH):
            full, _, _ = mine.sketch(row, plan)
            shard = (full // np.uint64(plan.cells)).astype(np.int32)
            out.append(B.sent(block, plan.shards, shard, **{f"row{row}": lambda k, f=full: B.pack_sorted(f[k] % np.uint64(plan.cells))}))
        return pa.concat_tables(out)

    def merge(shard, table):
        lists = B.by_block(table)
        out = []
        for row in range(DEPTH):
            part = f"row{row}"
            out.append(B.bits_back(shard, part, B.in_several({b: B.unpack_sorted(x[part]) for b, x in lists.items() if part in x})))
        return pa.concat_tables(out)

    def estimated(mine, back):
        """Which of a block's windows the merged sketch counts twice or more."""
        repeated = np.ones(len(mine.h1), bool)
        for row in range(DEPTH):
            full, twice, cells = mine.sketch(row, plan)
            shard = (full // np.uint64(plan.cells)).astype(np.int32)
            twice = twice | B.read_bits(back, f"row{row}", shard, plan.shards)
            repeated &= twice[np.searchsorted(full, cells)]
        return np.flatnonzero(repeated)

    def exact(block, table, back):
        mine = Block(table, plan.window)
        shard, h1, h2, ids, _ = mine.exact(estimated(mine, back), plan)
        return B.sent(block, plan.shards, shard, h1=lambda k: B.pack_sorted(h1[k]), h2=lambda k: B.pack(h2[k]), id=lambda k: B.pack(ids[k].view(np.uint64)))

    def group(shard, table):
        lists = {b: (B.unpack_sorted(x["h1"]), B.unpack(x["h2"]), B.unpack(x["id"]).view(np.int64)) for b, x in B.by_block(table).items()}
        return B.bits_back(shard, "older", older_elsewhere(lists))

    def keep(block, table, back):
        mine = Block(table, plan.window)
        repeated = estimated(mine, back)
        shard, _, _, ids, entry = mine.exact(repeated, plan)
        older = B.read_bits(back, "older", shard, plan.shards)
        gone = repeated[older[entry] | (ids[entry] < mine.ids[mine.text_of[repeated]])]
        by_text = np.searchsorted(mine.text_of[gone], np.arange(len(mine.ids) + 1))
        out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256")}
        for i, t in enumerate(mine.texts):
            kept, removed = t.split(), 0
            starts = mine.place[gone[by_text[i] : by_text[i + 1]]]
            if len(starts):
                mask = H.covered(starts, plan.window, len(kept))
                removed = int(mask.sum())
                kept = [kept[k] for k in np.flatnonzero(~mask)]
            body = b" ".join(kept)
            for k, v in zip(out, (None if mine.ids[i] == B.NO_ID else int(mine.ids[i]), int(mine.n_words[i]), removed, body.decode(), hashlib.sha256(body).hexdigest()), strict=True):
                out[k].append(v)
        return B.rows(KEPT, **out)

    first = B.answer(B.ask(d, B.SENT, sketch), merge)
    second = B.answer(B.ask_again(d, first, B.SENT, exact), group)
    return B.ask_again(d, first.unionByName(second), KEPT, keep)


def older_elsewhere(lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each block's entries (h1, h2, least id): whether another block's entry of the same key has a smaller id."""
    sizes = [len(x[0]) for x in lists.values()]
    h1, h2, ids = (np.concatenate([x[k] for x in lists.values()]) if lists else np.empty(0, np.int64) for k in range(3))
    order = np.lexsort((h2, h1))
    a, b, i = h1[order], h2[order], ids[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.minimum.reduceat(i, np.flatnonzero(new)) if len(i) else i
    out = np.empty(len(a), bool)
    out[order] = least[np.cumsum(new) - 1] < i
    return dict(zip(lists, np.split(out, np.cumsum(sizes)[:-1]) if sizes else [], strict=True))
