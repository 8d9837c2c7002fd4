"""Similarity self-join of word-shingle sets, with token-combination prefixes.

Tokens are hashed shingles, ordered rare first by document frequency. A pair
with Jaccard similarity of at least t shares one signature of its prefixes:

* A rare token is a signature by itself, and one unit of the prefix.
* A frequent token (in FREQUENT sets or more) belongs to one of some classes
  by hash. Within a class signatures are pairs of tokens, so the first token of
  a class adds no unit. The prefix is extended until it has one unit more than
  the tokens that the set may miss: were there no common signature, each class
  would have one common token at most, and more tokens would be missing than
  the threshold allows.
* The number of classes grows with the set (CLASSES up to 2047 tokens), so that
  signatures stay in proportion to it. Sets under CLASSES / t tokens may be too
  small for classes and use single tokens. A set indexes in the way of every
  size that its partners may have.
* A token in no other set makes a unit, but no signature.

Passes over the blocks (blocks.py):
1. Distinct tokens go out as packed sketch cells with counts, and set digests
   with their least doc_id. Answers: a frequency class for each token (by
   cell, so it is the same everywhere), the class representative of each set.
   Equal sets are one *node* from here on; a node is known by its place in a
   block, not by an id, so null and repeated ids join nothing.
2. Nodes send signatures. A shard assigns each list of one signature to a unit
   led by its first node. A list over UNIT sets or UNIT_TOKENS tokens is cut
   into parts, each a unit together with the list's first LEADERS nodes.
3. Blocks send the sets named to their units; a unit verifies its pairs by
   exact counts, skipping pairs already joined, and emits a forest.
4. If lists were cut: components so far, then units for those pairs of parts of
   a list that lie in different components. What is one group already, such as
   the copies of one template, needs no pair of parts.
Then components, with the graph in the cluster.

Defined results: null or empty texts have no shingles, link with nothing and
are their own component; texts of fewer words than a shingle have one; rows
with equal ids but other texts are documents of their own; the least id of a
component is its label, and a null id counts as the largest, so that a null
component has only null ids; other columns are ignored; an empty table gives
none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwright.llm import blocks as B
from loomwright.llm import hashing as H
from loomwright.operators.graph import components
from loomwright.sources.shared import written

#: Cells of the frequency sketch for each token.
WIDTH = 64
#: Frequency (as a bit length) from which a token is frequent.
FREQUENT = 7
CLASSES = 32
#: Most sets of a unit's side, and most tokens of them in the mean.
UNIT = 2048
UNIT_TOKENS = 1 << 21
LEADERS = 4
CLASSED = "doc_id long, n_shingles long, class_id long, component_id long"
EDGES = "a binary, b binary"


class Block:
    """A block's sets: distinct tokens by text, sorted."""

    def __init__(self, table: pa.Table, width: int, rows: np.ndarray | None = None):
        self.ids, self.texts = B.ids_and_texts(table)
        if rows is not None:
            self.ids, self.texts = self.ids[rows], [self.texts[i] for i in rows.tolist()]
        owner, token = [], []
        for first, _, data, offsets in H.chunks(self.texts):
            starts, ends, text = H.words(H.lower_ascii(data), offsets)
            if not len(starts):
                continue
            hashes = H.word_hashes(H.lower_ascii(data), starts, ends)
            at, window = H.word_windows(hashes, text, width)
            o, h = text[at], window
            counts = np.bincount(text, minlength=len(offsets) - 1)
            few = np.flatnonzero((counts > 0) & (counts < width))
            if len(few):
                begin = np.searchsorted(text, few)
                whole = [H.mix(H.sliding(hashes[b : b + counts[f]], int(counts[f])), 50 + int(counts[f]))[0] for f, b in zip(few.tolist(), begin.tolist(), strict=True)]
                o, h = np.concatenate([o, few]), np.concatenate([h, np.array(whole, np.uint64)])
            order = np.lexsort((h, o))
            o, h = o[order], h[order]
            new = np.ones(len(o), bool)
            new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
            owner.append((o[new] + first).astype(np.int32))
            token.append(h[new])
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int32)
        self.token = np.concatenate(token) if token else np.empty(0, np.uint64)
        self.begin = np.searchsorted(self.owner, np.arange(len(self.ids) + 1))
        self.size = np.diff(self.begin)

    def digests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct sets of the block: two digests and the least id of each, sorted; and the entry of each text (-1: no shingles)."""
        full = np.flatnonzero(self.size)
        entry = np.full(len(self.ids), -1)
        if not len(full):
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), entry
        a, b = (np.add.reduceat(H.mix(self.token, s), self.begin[full]) for s in (31, 32))
        order = np.lexsort((self.ids[full], b, a))
        x, y = a[order], b[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        entry[full[order]] = np.cumsum(new) - 1
        return x[new], y[new], self.ids[full][order][new], entry

    def cells(self, shards: int, cells: int, entry: np.ndarray):
        """Filled cells, sorted, the number of distinct sets in each, and the cell of each token."""
        cell = H.mix(self.token, 40) % np.uint64(shards * cells)
        _, once = np.unique(entry, return_index=True)
        first = np.zeros(len(self.ids), bool)
        first[once] = True
        full, inverse = np.unique(cell, return_inverse=True)
        return full, np.bincount(inverse, weights=first[self.owner], minlength=len(full)).astype(np.int64), inverse


def classes_of(n: int, percent: int) -> int:
    """Number of classes for sets of n tokens; 0: single tokens."""
    if n < -(-100 * (CLASSES + 12) // percent):
        return 0
    return CLASSES << 2 * max(0, (n.bit_length() - 10) // 2)


def signatures(token: np.ndarray, frequency: np.ndarray, percent: int) -> np.ndarray:
    """Of one set; its tokens in any order, with their frequency classes."""
    n = len(token)
    order = np.lexsort((token, frequency))
    token, frequency = token[order], frequency[order]
    least = -(-percent * n // 100)
    need = n - least + 1
    lowest, highest = classes_of(least, percent), classes_of(n * 100 // percent, percent)
    rare = int(np.searchsorted(frequency, FREQUENT))
    out = []
    for classes in (0, *(CLASSES << 2 * k for k in range(20))):
        if not lowest <= classes <= highest or classes and n < -(-100 * (classes + 12) // percent):
            continue
        if not classes or rare >= need:
            out.append(H.mix(token[:need][frequency[:need] > 1], 60 + 2 * classes))
            continue
        out.append(H.mix(token[:rare][frequency[:rare] > 1], 60 + 2 * classes))
        often = token[rare:]
        group = (H.mix(often, 62) % np.uint64(classes)).astype(np.int64)
        by_group = np.argsort(group, kind="stable")
        g = group[by_group]
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        unit = np.ones(len(g), np.int64)
        unit[by_group[first]] = 0
        end = int(np.searchsorted(np.cumsum(unit), need - rare)) + 1
        for c in np.unique(group[:end]).tolist():
            mine = H.mix(np.sort(often[:end][group[:end] == c]), 63)
            a, b = np.triu_indices(len(mine), 1)
            out.append(H.mix(mine[a] + (mine[b] << np.uint64(1)), 61 + 2 * classes))
    return np.unique(np.concatenate(out))


def node_names(ids: np.ndarray, keys: np.ndarray) -> list[bytes]:
    """16 bytes that are in the order of ids, then keys."""
    both = np.empty((len(ids), 2), ">u8")
    both[:, 0] = ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    both[:, 1] = keys.astype(np.uint64)
    return [x.tobytes() for x in both]


def _half(name: str, k: int) -> Column:
    """The number in one half of a node's name."""
    return F.conv(F.hex(F.substring(name, 8 * k + 1, 8)), 16, 10).cast("decimal(20,0)")


def _power(parts: int) -> int:
    return 1 << max(0, parts - 1).bit_length()


def parts_of(count: int, tokens: int) -> int:
    """Parts of a list of so many sets with so many tokens."""
    return _power(max(-(-count // UNIT), -(-tokens // UNIT_TOKENS)))


def cut_by_label(key: np.ndarray, size: np.ndarray, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each member of a list, its part and all parts that it must meet; parts are named so that like lists name them alike.

    A label with many members has parts of its own, which needn't meet each other; the rest are dealt by label.
    """
    kinds, of, count = np.unique(label, return_inverse=True, return_counts=True)
    tokens = np.bincount(of, weights=size).astype(np.int64)
    own = (count >= UNIT // 2) | (tokens >= UNIT_TOKENS // 2)
    subs = np.array([parts_of(c, t) if o else 0 for c, t, o in zip(count.tolist(), tokens.tolist(), own.tolist(), strict=True)], np.uint64)
    rest = np.uint64(parts_of(int(count[~own].sum()), int(tokens[~own].sum())))
    hashed = H.mix(key.view(np.uint64), 70)
    mine = own[of]
    part = np.where(mine, H.mix(H.mix(kinds.view(np.uint64), 71)[of] + hashed % np.maximum(subs[of], np.uint64(1)) + (subs[of] << np.uint64(20)), 72), H.mix(H.mix(kinds.view(np.uint64), 73)[of] % rest + (rest << np.uint64(20)), 74))
    names, first = np.unique(part, return_index=True)
    kind = np.where(mine[first], of[first], -1)
    meets = {n: names[(kind != k) | (kind < 0)] for n, k in zip(names.tolist(), kind.tolist(), strict=True)}
    return [(p, meets[p]) for p in part.tolist()]


def verified(side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of the links in a unit, by place: among all (one side only), or from side 0 to side 1."""
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(int(flat.max()) + 1, np.int32)
    root = np.arange(len(sets))
    crossed = bool(side.max())
    links = []
    for i in range(len(sets)):
        if crossed and side[i]:
            continue
        other = np.flatnonzero((side == 1) if crossed else (np.arange(len(sets)) > i))
        other = other[(root[other] != root[i]) & (100 * np.minimum(sizes[other], sizes[i]) >= percent * np.maximum(sizes[other], sizes[i]))]
        if not len(other):
            continue
        mine = flat[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        spans = sizes[other]
        ends = np.cumsum(spans)
        at = np.arange(ends[-1]) - np.repeat(ends - spans, spans) + np.repeat(starts[other], spans)
        common = np.add.reduceat(mark[flat[at]], ends - spans)
        mark[mine] = 0
        for j in other[100 * common >= percent * (spans + sizes[i] - common)].tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                links.append((i, j))
    return links


class Join:
    """The passes of a join. After run(): facts, each block's rows (doc_id, n_shingles, class_id, node), and labels, each linked node's label."""

    def __init__(self, docs: DataFrame, width: int, percent: int, doc_id: str, text: str, kept: bool = False):
        self.width, self.percent = width, percent
        self.shards, total = B.count_blocks(docs, text)
        self.cells = max(1 << 12, WIDTH * (total // (5 * self.shards) + 1))
        self.d = B.into_blocks(docs, self.shards, doc_id, text, kept)

    def run(self) -> None:
        d, shards, cells, width, percent = self.d, self.shards, self.cells, self.width, self.percent

        def tell(block, table):
            mine = Block(table, width)
            a, b, ids, entry = mine.digests()
            full, count, _ = mine.cells(shards, cells, entry)
            shard = (a % np.uint64(shards)).astype(np.int32)
            o = np.lexsort((b, a, shard))
            own = B.sent(
                block, shards, shard[o], a=lambda k: B.pack_sorted(a[o][k]), b=lambda k: B.pack(b[o][k]),
                id=lambda k: B.pack(ids[o][k].view(np.uint64)), place=lambda k: B.pack(np.array([k.start], np.uint64)),
            )
            cell_shard = (full // np.uint64(cells)).astype(np.int32)
            return pa.concat_tables([own, B.sent(block, shards, cell_shard, cell=lambda k: B.pack_sorted(full[k] % np.uint64(cells)), count=lambda k: B.pack(np.minimum(count[k], 65535).astype(np.uint16)))])

        def merge(shard, table):
            lists = B.by_block(table)
            tokens = {b: (B.unpack_sorted(x["cell"]), B.unpack(x["count"])) for b, x in lists.items() if "cell" in x}
            out = {"block": [], "shard": [], "part": [], "body": []}

            def put(block, part, body):
                for k, v in zip(out, (block, shard, part, body), strict=True):
                    out[k].append(v)

            if tokens:
                cell, inverse = np.unique(np.concatenate([c for c, _ in tokens.values()]), return_inverse=True)
                count = np.bincount(inverse, weights=np.concatenate([n for _, n in tokens.values()]), minlength=len(cell)).astype(np.int64)
                frequency = np.minimum(np.floor(np.log2(np.maximum(count, 1))) + 1, 60).astype(np.uint8)
                for b, part in zip(tokens, np.split(inverse, np.cumsum([len(c) for c, _ in tokens.values()])[:-1]), strict=True):
                    put(b, "frequency", B.pack(frequency[part]))
            sets = {}
            for b, x in lists.items():
                if "a" in x:
                    a = B.unpack_sorted(x["a"])
                    sets[b] = a, B.unpack(x["b"]), B.unpack(x["id"]).view(np.int64), (b << 32) + int(B.unpack(x["place"])[0]) + np.arange(len(a))
            if sets:
                a, b, i, key = (np.concatenate([x[k] for x in sets.values()]) for k in range(4))
                o = np.lexsort((key, i, b, a))
                new = np.ones(len(a), bool)
                new[1:] = (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])
                least, node = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
                least[o], node[o] = i[o][new][np.cumsum(new) - 1], key[o][new][np.cumsum(new) - 1]
                at = np.cumsum([len(x[0]) for x in sets.values()])[:-1]
                for blk, x, y in zip(sets, np.split(least, at), np.split(node, at), strict=True):
                    put(blk, "class", B.pack(x.view(np.uint64)))
                    put(blk, "node", B.pack(y.view(np.uint64)))
            return B.rows(B.ANSWER, **out)

        def index(block, table, back):
            mine = Block(table, width)
            a, b, ids, entry = mine.digests()
            full, _, inverse = mine.cells(shards, cells, entry)
            got = {(p, s): x for p, s, x in zip(back.column("part").to_pylist(), back.column("shard").to_pylist(), back.column("body").to_pylist(), strict=True)}
            frequency = np.zeros(len(full), np.uint8)
            at = B.cuts((full // np.uint64(cells)).astype(np.int32), shards)
            shard = (a % np.uint64(shards)).astype(np.int32)
            o = np.lexsort((b, a, shard))
            cut = B.cuts(shard[o], shards)
            of_entry, node = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
            for s in range(shards):
                if at[s] < at[s + 1]:
                    frequency[at[s] : at[s + 1]] = B.unpack(got["frequency", s])
                if cut[s] < cut[s + 1]:
                    of_entry[o[cut[s] : cut[s + 1]]] = B.unpack(got["class", s]).view(np.int64)
                    node[o[cut[s] : cut[s + 1]]] = B.unpack(got["node", s]).view(np.int64)
            place = np.empty(len(a), np.int64)
            place[o] = np.arange(len(a))
            chosen = node == (block << 32) + place  # the nodes of this block
            has = entry >= 0
            class_of = np.where(has, of_entry[entry] if len(a) else 0, mine.ids)
            node_of = np.where(has, node[entry] if len(a) else 0, -1)
            _, first = np.unique(entry, return_index=True)
            first = first[has[first]]
            sig, own = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for i in first[chosen[entry[first]]].tolist():
                part = slice(mine.begin[i], mine.begin[i + 1])
                s = signatures(mine.token[part], frequency[inverse[part]], percent)
                sig.append(s)
                own.append(np.full(len(s), i))
            sig, own = np.concatenate(sig), np.concatenate(own)
            sig_shard = (sig % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((sig, sig_shard))
            sig, own = sig[order], own[order]
            at_place = place[entry[own]]
            out = B.sent(block, shards, sig_shard[order], sig=lambda k: B.pack_sorted(sig[k]), place=lambda k: B.pack(at_place[k].astype(np.uint32)), size=lambda k: B.pack(mine.size[own[k]].astype(np.uint32)))
            row_of = np.full(len(a), -1)
            row_of[place[entry[first]]] = first
            facts = [B.pack(x.astype(np.int64).view(np.uint64)) for x in (mine.ids, mine.size, class_of, node_of, row_of)]
            return pa.concat_tables([out, B.rows(B.SENT, shard=[-1] * 5, block=[block] * 5, part=["doc_id", "n_shingles", "class_id", "node", "row"], body=facts)])

        def lists_of(table):
            """key (block and place) and size of the members of each signature that several sets of fitting sizes have."""
            lists = B.by_block(table)
            parts = [(B.unpack_sorted(x["sig"]), B.unpack(x["place"]).astype(np.int64) + (b << 32), B.unpack(x["size"]).astype(np.int64)) for b, x in lists.items()]
            sig, key, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((key, sig))
            sig, key, size = sig[order], key[order], size[order]
            begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            count = np.diff(begin, append=len(sig))
            for b, n in zip(begin[count > 1].tolist(), count[count > 1].tolist(), strict=True):
                k, s = key[b : b + n], size[b : b + n]
                by_size = np.sort(s)
                near = np.searchsorted(by_size, s * 100 // percent, "right") - np.searchsorted(by_size, -(-s * percent // 100)) > 1
                if near.sum() > 1:
                    yield k[near], s[near]

        def told(shard, to: dict[int, set], cut: list[tuple[np.ndarray, np.ndarray]]):
            """Units by block; and, as of block -1, the lists that are cut."""
            blocks = sorted(to)
            part = ["units"] * len(blocks)
            body = [B.pack(np.array(sorted(to[b]), np.uint64).reshape(-1)) for b in blocks]
            if cut:
                blocks += [-1] * 3
                part += ["length", "key", "size"]
                body += [B.pack(np.array([len(k) for k, _ in cut], np.uint64)), *(B.pack(np.concatenate([x[j] for x in cut]).astype(np.uint64)) for j in range(2))]
            return B.rows(B.ANSWER, block=blocks, shard=[shard] * len(blocks), part=part, body=body)

        def assign(shard, table):
            """Units by block: place, leader, two parts, side."""
            to: dict[int, set] = {}
            cut = []
            for key, size in lists_of(table):
                parts = parts_of(len(key), int(size.sum()))
                leader = int(key[0])
                if parts > 1:
                    cut.append((key, size))
                part = (H.mix(key.view(np.uint64), 70) % np.uint64(parts)).astype(np.int64) + (parts << 20)
                for k, p in zip(key.tolist(), part.tolist(), strict=True):
                    to.setdefault(k >> 32, set()).add((k & 0xFFFFFFFF, leader, p, p, 0))
                if parts > 1:
                    for k in key[:LEADERS].tolist():
                        to.setdefault(k >> 32, set()).update((k & 0xFFFFFFFF, leader, p, p, 0) for p in np.unique(part).tolist())
            return told(shard, to, cut)

        def assign_rest(shard, table, known):
            """Units for the pairs of parts of cut lists that are in different components so far."""
            if not table.num_rows or not known.num_rows:
                return B.rows_like(B.ANSWER)
            nodes, label = known.column("node").to_numpy(), known.column("label").to_numpy()
            order = np.argsort(nodes)
            nodes, label = nodes[order], label[order]
            to: dict[int, set] = {}
            got = dict(zip(table.column("part").to_pylist(), map(B.unpack, table.column("body").to_pylist()), strict=True))
            ends = np.cumsum(got["length"].astype(np.int64))[:-1]
            for key, size in zip(*(np.split(got[x].astype(np.int64), ends) for x in ("key", "size")), strict=True):
                at = np.minimum(np.searchsorted(nodes, key), len(nodes) - 1)
                mine = np.where(nodes[at] == key, label[at], key)
                if (mine == mine[0]).all():
                    continue
                leader = int(key[0])
                for k, (p, meets) in zip(key.tolist(), cut_by_label(key, size, mine), strict=True):
                    to.setdefault(k >> 32, set()).update((k & 0xFFFFFFFF, leader, min(p, q), max(p, q), int(p > q)) for q in meets.tolist())
            return told(shard, to, [])

        def gather(block, table, back):
            rows, units = (back.filter(pa.compute.equal(back.column("part"), x)) for x in ("row", "units"))
            asked = [B.unpack(x).reshape(-1, 5) for x in units.column("body").to_pylist()]
            if not asked:
                return B.rows_like(B.SENT)
            asked = np.unique(np.concatenate(asked), axis=0)
            place, at = np.unique(asked[:, 0].astype(np.int64), return_inverse=True)
            row_of = B.unpack(rows.column("body")[0].as_py()).view(np.int64)
            mine = Block(table, width, row_of[place])
            unit = np.zeros(len(asked), np.uint64)
            for k in range(1, 4):
                unit = H.mix(unit + asked[:, k], 80 + k)
            shard = (unit % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((asked[:, 0], unit, shard))
            at, unit, side = at[order], unit[order], asked[order, 4].astype(np.uint8)
            body = [mine.token[mine.begin[p] : mine.begin[p + 1]] for p in at.tolist()]
            lengths = mine.size[at].astype(np.uint32)
            ids, key = mine.ids[at], place[at] + (block << 32)
            return B.sent(
                block, shards, shard[order],
                unit=lambda k: B.pack_sorted(unit[k]), id=lambda k: B.pack(ids[k].view(np.uint64)), key=lambda k: B.pack(key[k].view(np.uint64)), side=lambda k: B.pack(side[k]),
                length=lambda k: B.pack(lengths[k]), body=lambda k: B.pack(np.concatenate(body[k])),
            )

        def verify(shard, table):
            units: dict[int, list] = {}
            for x in B.by_block(table).values():
                lengths = B.unpack(x["length"]).astype(np.int64)
                tokens = np.split(B.unpack(x["body"]), np.cumsum(lengths)[:-1])
                names = node_names(B.unpack(x["id"]), B.unpack(x["key"]))
                for u, i, s, t in zip(B.unpack_sorted(x["unit"]).tolist(), names, B.unpack(x["side"]).tolist(), tokens, strict=True):
                    units.setdefault(u, []).append((i, s, t))
            links = []
            for members in units.values():
                members.sort(key=lambda m: m[:2])
                names, side, sets = zip(*members, strict=True)
                if len(names) > 1:
                    links += [(names[i], names[j]) for i, j in verified(np.array(side), list(sets), percent)]
            return B.rows(EDGES, a=[x[0] for x in links], b=[x[1] for x in links])

        def spread(batches):
            for b in batches:
                for s, x in zip(b.column("shard").to_pylist(), b.column("body").to_pylist(), strict=True):
                    nodes = np.unique(B.unpack(x)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), s, np.int32)), pa.array(nodes)], names=["shard", "node"])

        first = B.answer(B.ask(d, B.SENT, tell), merge)
        second = written(B.ask_again(d, first, B.SENT, index), "signatures")
        rows = second.where("part = 'row'")

        def edges_of(units: DataFrame) -> DataFrame:
            return B.answer(B.ask_again(d, units.where("block >= 0").unionByName(rows.select(*units.columns)), B.SENT, gather), verify, EDGES)

        third = written(B.answer(second.where("shard >= 0"), assign), "units")
        labels = components(edges_of(third))
        cut = third.where("block < 0")
        need = cut.where("part = 'key'")
        if need.limit(1).count():
            key = labels.select(_half("node", 1).cast("long").alias("node"), _half("label", 1).cast("long").alias("label"))
            known = need.select("shard", "body").mapInArrow(spread, "shard int, node long").join(key, "node")
            # a shard none of whose cut lists' nodes are linked has them all apart
            known = known.unionByName(need.select("shard", F.lit(-1).cast("long").alias("node"), F.lit(-1).cast("long").alias("label")))
            rest = cut.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(lambda k, a, b: assign_rest(k[0].as_py(), a, b), B.ANSWER)
            rest = edges_of(written(rest, "units"))
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(rest))
        self.facts = second.where("shard < 0")
        self.labels = labels

    def labels_by_block(self) -> DataFrame:
        """block, node, label id and label node, for each linked node that rows of the block belong to: a row for each block, however many copies it has."""

        def spread(batches):
            for b in batches:
                for k, x in zip(b.column("block").to_pylist(), b.column("body").to_pylist(), strict=True):
                    nodes = np.unique(B.unpack(x).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), k, np.int32)), pa.array(nodes)], names=["block", "node"])

        least = (_half("label", 0) - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long").alias("least")
        named = self.labels.select(_half("node", 1).cast("long").alias("node"), least, _half("label", 1).cast("long").alias("label"))
        return self.facts.where("part = 'node'").select("block", "body").mapInArrow(spread, "block int, node long").join(named, "node")


def _labelled(facts: pa.Table, labels: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """A block's rows by column, and each row's component's least id and node."""
    parts = {p: B.unpack(x).view(np.int64) for p, x in zip(facts.column("part").to_pylist(), facts.column("body").to_pylist(), strict=True)}
    nodes = labels.column("node").to_numpy()
    order = np.argsort(nodes)
    node, least, label = parts["node"], parts["class_id"].copy(), parts["node"].copy()
    if len(nodes):
        at = order[np.minimum(np.searchsorted(nodes, node, sorter=order), len(nodes) - 1)]
        linked = nodes[at] == node
        least[linked], label[linked] = labels.column("least").to_numpy()[at][linked], labels.column("label").to_numpy()[at][linked]
    return parts, least, label


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (least id with an equal set) and component_id (least id reachable by links) of each row."""
    join = Join(docs, width, percent, doc_id, text)
    join.run()

    def told(key, facts, labels):
        if not facts.num_rows:
            return B.rows_like(CLASSED)
        parts, least, _ = _labelled(facts, labels)
        columns = {"doc_id": parts["doc_id"], "n_shingles": parts["n_shingles"], "class_id": parts["class_id"], "component_id": least}
        return pa.table({n: pa.array(v, mask=(v == B.NO_ID) & (n != "n_shingles")) for n, v in columns.items()})

    return join.facts.groupBy("block").cogroup(join.labels_by_block().groupBy("block")).applyInArrow(told, CLASSED)


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of least id (any of equal rows of that id and text); rows without words stay. All columns are kept."""
    join = Join(docs, width, percent, doc_id, text, kept=True)
    join.run()
    told = join.labels_by_block().select("block", F.lit("label").alias("part"), F.lit(None).cast("binary").alias("body"), "node", "least", "label")
    back = join.facts.select("block", "part", "body", *(F.lit(None).cast("long").alias(c) for c in ("node", "least", "label"))).unionByName(told)
    own = [c for c in join.d.columns if c not in ("doc_id", "block")]

    def keep(key, table, back):
        if not table.num_rows:
            return table.select(own)
        is_label = pa.compute.equal(back.column("part"), "label")
        parts, _, label = _labelled(back.filter(pa.compute.invert(is_label)), back.filter(is_label))
        order, _, _ = B.row_order(table)
        stays = parts["n_shingles"] == 0
        row_of = parts["row"]
        rep = np.zeros(len(order), bool)
        rep[row_of[row_of >= 0]] = True
        place = np.full(len(order), -1)
        place[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
        block = key[0].as_py()
        stays |= rep & (parts["node"] == (block << 32) + place) & (label == parts["node"])
        return table.select(own).take(pa.array(np.array(order)[stays]))

    schema = StructType([join.d.schema[c] for c in own])
    out = join.d.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(keep, schema)
    number = {c: k for k, c in enumerate(docs.columns)}
    return out.select(*(F.col("text" if c == text else f"own{number[c]}").alias(c) for c in docs.columns))
