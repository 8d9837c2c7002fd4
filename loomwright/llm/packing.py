"""Best-fit packing of tokenised documents into sequences, by linear grouping.

Lengths are at most `capacity`, so the whole corpus enters the plan as a
histogram of at most `capacity` numbers; the plan is made on the driver from
it, and its size doesn't depend on the corpus:

1. Large lengths (over capacity / SMALL) are sorted and cut into GROUPS groups
   of equal cardinality; within each, lengths are rounded up to the largest.
2. The configuration LP over the few rounded sizes is solved by column
   generation (revised simplex; pricing is a knapsack over integer capacities).
   Each configuration is used a whole number of times; what rounding leaves
   over joins step 4.
3. Actual documents take the slots of their group, in order of length. Bins
   are kept as runs of equal bins, which this cuts at changes of length only.
   Runs that rounding leaves with a gap too large to waste and too small to
   fill are given up.
4. Left-over large lengths, then small ones, go best-fit, longest first. How
   small a gap is too small is tried, up to giving up all runs, and the plan
   of fewest bins is taken: never more than plain best-fit needs.

The plan says, for each length, which ranks among the pieces of that length go
to which bins. Ranks are counted in the pieces' written table: each task of
the tokenising stage numbers its own pieces of each length, and the counts of
(task, length) give the offsets. No piece is sorted, and a length that holds
half of the pieces is no heavier than another.

Defined results: null and empty texts are one token (the end token); texts of
any length and content are encoded whole; equal texts are packed like any others; rows with equal or null ids are packed each
for itself; other columns are ignored; an empty table gives no sequences.
"""

from __future__ import annotations

import base64
import bisect
import functools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.sources.shared import discard, written  # noqa: F401

CAPACITY = 1024
END_ID = 2
#: Lengths up to capacity / SMALL are small.
SMALL = 2.5
GROUPS = 256
#: A configuration's use stays if at most WASTE tokens of it are free, or so many that small pieces fill them: one of ROOMS, whichever needs fewest bins.
WASTE = 1
ROOMS = (0, 30, 60, 120, 240)
#: Pricing steps for each size at most: what an unfinished LP leaves is packed best-fit.
STEPS = 12
#: Characters of white space in one run from which a text goes to the slower tokenizer; the rank encoder's stack ends at some 800 000.
LONG_SPACE = 1 << 16
SPACE = re.compile(r"\s{64,}")
#: Bytes of text given to the tokenizer at once.
BATCH_BYTES = 1 << 20
PIECES = "doc_id long, piece int, start long, length int, ids binary, task int, rank long"


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str | None]:
    """Paths of a public byte-level vocabulary: for `tokenizers`, and as ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    """Token ids of texts, as `tokenizers` gives them with add_special_tokens=False.

    The byte-level vocabulary is also run as ranks (the same ids, five times
    as fast); a text that holds a special token's string, or a very long run of
    white space, goes to `tokenizers`.
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.json_path, self.fast = json_path, None
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        if ranks_path is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def full(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def __call__(self, text: str) -> np.ndarray:
        spaced = len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in SPACE.finditer(text))
        if self.fast is None or spaced or any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@functools.lru_cache(maxsize=1)
def encoder(json_path: str, ranks_path: str | None) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(json_path, ranks_path)


def tokenized_pieces(docs: DataFrame, capacity: int, json_path: str, ranks_path: str | None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document: a first one that may be shorter, then full ones; ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(json_path, ranks_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        out: list[tuple] = []
        size = 0

        def flush():
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(t.as_py() or ""), np.uint32(end_id)).astype("<u4")
                head = len(ids) % capacity or capacity
                bounds = [0, *range(head, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    out.append((i.as_py(), k, a, b - a, ids[a:b].tobytes(), task, int(seen[b - a])))
                    seen[b - a] += 1
                size += 4 * len(ids)
                if size >= BATCH_BYTES:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    one = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return one.mapInArrow(run, PIECES)


# --- the plan ---------------------------------------------------------------------------------------------------------


def _inverse(basis: np.ndarray) -> np.ndarray:
    """By elimination, elementwise: threads of a linear-algebra library have hung in a driver beside the JVM."""
    m = len(basis)
    both = np.concatenate([basis, np.eye(m)], axis=1)
    for k in range(m):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, m:]


def _of_two(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of largest price of at most two pieces: to each size the dearest other that fits."""
    order = np.argsort(sizes, kind="stable")
    up, dear = sizes[order], prices[order]
    top = np.maximum.accumulate(dear)
    where = np.maximum.accumulate(np.where(np.r_[True, dear[1:] > top[:-1]], np.arange(len(up)), 0))
    fits = np.searchsorted(up, capacity - up, "right") - 1  # the last size that fits beside each
    gain = dear + np.where(fits >= 0, top[np.maximum(fits, 0)], 0)
    k = int(gain.argmax())
    new = np.zeros(len(sizes))
    new[order[k]] += 1
    if fits[k] >= 0:
        new[order[where[fits[k]]]] += 1
    return float(gain[k]), new


def price(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of largest price, a knapsack over integer sizes."""
    if capacity // int(sizes.min()) <= 2:
        return _of_two(sizes, prices, capacity)
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fit = np.flatnonzero(sizes <= c)
        gain = best[c - sizes[fit]] + prices[fit]
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = gain[k], fit[k]
        else:
            best[c] = best[c - 1]
    new, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            new[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), new


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns over the sizes, and how often (a real number) an optimal covering of the demand uses each."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    use = demand / np.diag(basis)
    inverse = np.diag(1 / np.diag(basis))
    for step in range(STEPS * m):
        if step % 50 == 49:
            inverse = _inverse(basis)
            use = (inverse * demand).sum(axis=1)
        worth, new = price(sizes, np.maximum(inverse.sum(axis=0), 0), capacity)
        if use.sum() * (1 - 1 / max(worth, 1)) < 0.5:  # no solution is better by half a bin
            break
        column = (inverse * new).sum(axis=1)
        rising = column > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, np.maximum(use, 0) / np.where(rising, column, 1), np.inf)
        out = int(ratio.argmin())
        use -= ratio[out] * column
        use[out] = ratio[out]
        basis[:, out] = new
        pivot = inverse[out] / column[out]
        inverse -= column[:, None] * pivot
        inverse[out] = pivot
    return [basis[:, k].astype(int) for k in range(m)], np.maximum(use, 0)


@dataclass
class Placed:
    """Pieces of one length, by rank: `each` of them in each bin from `bin` on, the first at `offset`."""

    length: int
    rank: int
    count: int
    bin: int
    each: int
    offset: int


def filled_uses(histogram: dict[int, int], capacity: int, groups: int, small: float) -> list[tuple[list[int], int]]:
    """The large pieces of each bin that configurations fill with actual lengths, and in how many bins they are so."""
    # 1. groups of equal cardinality, the longest first; each is rounded up to its longest length
    large = [n for n in sorted(histogram, reverse=True) if n > capacity // small]
    total = sum(histogram[n] for n in large)
    grouped: list[list[list[int]]] = []
    per = -(-total // groups)  # up to as many pieces as groups, nothing is rounded
    room = 0
    for n in large:
        count = histogram[n]
        while count:
            if not room:
                grouped.append([])
                room = per
            take = min(count, room)
            grouped[-1].append([n, take])
            count, room = count - take, room - take
    by_size: dict[int, list[list[int]]] = {}
    for g in grouped:
        by_size.setdefault(g[0][0], []).extend(g)
    if not by_size:
        return []
    sizes = np.array(list(by_size), np.int64)
    demand = np.array([sum(c for _, c in g) for g in by_size.values()], float)
    # 2. + 3. whole uses of each configuration, filled with actual lengths
    out: list[tuple[list[int], int]] = []
    slots = list(by_size.values())
    for pattern, use in zip(*configurations(sizes, demand, capacity), strict=True):
        uses = int(use + 1e-6)
        kinds = [k for k, many in enumerate(pattern) for _ in range(many)]
        have = {k: sum(c for _, c in slots[k]) for k in set(kinds)}
        uses = min([uses, *(have[k] // kinds.count(k) for k in have)])
        if not kinds or not uses:
            continue
        cut = {0, uses}
        taken: list[list[tuple[int, int, int]]] = []  # for each slot: (first use, uses, length)
        for k in kinds:
            at, mine = 0, []
            while at < uses:
                n, c = slots[k][0]
                take = min(c, uses - at)
                mine.append((at, take, n))
                at += take
                cut.add(at)
                slots[k][0][1] -= take
                if not slots[k][0][1]:
                    slots[k].pop(0)
            taken.append(mine)
        edges = sorted(cut)
        inside: list[list[int]] = [[] for _ in edges[1:]]  # the lengths of each run of equal uses
        for mine in taken:
            for at, take, n in mine:
                for e in range(edges.index(at), edges.index(at + take)):
                    inside[e].append(n)
        out += [(own, edges[e + 1] - edges[e]) for e, own in enumerate(inside)]
    return out


def pack_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> tuple[list[Placed], int]:
    """Where the pieces of each length go, and the number of bins.

    Of the filled uses those stay that leave at most WASTE tokens or at least so many as small pieces may fill; which, is tried
    (ROOMS, then none at all, which is plain best-fit), and the plan of fewest bins is taken, of equal ones the first.
    """
    histogram = {n: c for n, c in histogram.items() if c}
    uses = filled_uses(histogram, capacity, groups, small)
    kept = [[u for u in uses if not WASTE < capacity - sum(u[0]) < room] for room in (*ROOMS, capacity + 1)] + [[]]
    best = None
    for k, some in enumerate(kept):
        if k and some == kept[k - 1]:
            continue
        plan = _filled_plan(histogram, some, capacity)
        if best is None or plan[1] < best[1]:
            best = plan
    return best


def _filled_plan(histogram: dict[int, int], uses: list[tuple[list[int], int]], capacity: int) -> tuple[list[Placed], int]:
    """The plan with the given bins of large pieces, and all else best-fit, longest first."""
    left = dict(sorted(histogram.items(), reverse=True))
    next_rank = dict.fromkeys(left, 0)
    plan: list[Placed] = []
    bins = 0
    runs: dict[int, list[tuple[int, int]]] = {}  # free space -> (first bin, number)
    frees: list[int] = []  # in order

    def add(space: int, first: int, count: int) -> None:
        if count and space:
            if space not in runs:
                runs[space] = []
                bisect.insort(frees, space)
            runs[space].append((first, count))

    def place(length: int, count: int, first: int, each: int, offset: int) -> None:
        plan.append(Placed(length, next_rank[length], count, first, each, offset))
        next_rank[length] += count
        left[length] -= count

    for own, count in uses:
        at = 0
        for n in own:
            place(n, count, bins, 1, at)
            at += n
        add(capacity - at, bins, count)
        bins += count
    for n in sorted(left, reverse=True):
        for s in frees[bisect.bisect_left(frees, n) :]:
            if not left[n]:
                break
            each = s // n
            while left[n] and runs[s]:
                first, count = runs[s].pop()
                full = min(count, left[n] // each)
                if full:
                    place(n, full * each, first, each, capacity - s)
                    add(s - each * n, first, full)
                rest = count - full
                if rest and left[n]:
                    some = left[n]
                    place(n, some, first + full, some, capacity - s)
                    add(s - some * n, first + full, 1)
                    full, rest = full + 1, rest - 1
                if rest:
                    runs[s].append((first + full, rest))
            if not runs[s]:
                del runs[s]
                frees.remove(s)
        if left[n]:
            each = capacity // n
            full, some = divmod(left[n], each)
            if full:
                place(n, full * each, bins, each, 0)
                add(capacity - each * n, bins, full)
            if some:
                place(n, some, bins + full, some, 0)
                add(capacity - some * n, bins + full, 1)
            bins += full + bool(some)
    return plan, bins


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """sequence_id and offset for each of the written pieces (task and rank as tokenized_pieces numbers them)."""
    counts = pieces.groupBy("task", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = pack_plan(histogram, capacity, groups)
    by_length: dict[int, list[Placed]] = {}
    for p in plan:
        by_length.setdefault(p.length, []).append(p)
    table = {n: (np.array([[p.rank, p.bin, p.each, p.offset] for p in sorted(v, key=lambda p: p.rank)], np.int64)) for n, v in by_length.items()}
    from pyspark.sql import Window

    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = counts.select("task", "length", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "task")
    names = [c for c in ranked.columns if c != "rank"]
    schema = f"{', '.join(f'`{c}` {ranked.schema[c].dataType.simpleString()}' for c in names)}, sequence_id long, offset long"

    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                t = table[n]
                k = np.searchsorted(t[:, 0], rank[rows], "right") - 1
                inside = rank[rows] - t[k, 0]
                seq[rows] = t[k, 1] + inside // t[k, 2]
                off[rows] = t[k, 3] + inside % t[k, 2] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)
