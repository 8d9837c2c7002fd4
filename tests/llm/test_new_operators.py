"""Whitening, the conversation trie and the inverted index against brute force: nulls, empties, ties, repeats, hot keys, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import inverted, queries, trie, whitening
from loomwright.operators import skew


def plainly_whitened(vectors, scale, shift):
    """n, exact deviations, eigenvalues and eigenvectors (falling) and centred rows."""
    d = max(map(len, vectors))
    x = [[math.floor(max(min(float(np.float64(v[k])) * scale, 2.0**53), -(2.0**53))) + shift if k < len(v) else shift for k in range(d)] for v in vectors]
    n, sums = len(x), [sum(r[k] for r in x) for k in range(d)]
    scaled = [[n * r[k] - sums[k] for k in range(d)] for r in x]
    c = np.array([[float(v) / n for v in r] for r in scaled])
    _, sigma, vt = np.linalg.svd(c)
    return n, [sum(v * v for v in r) for r in scaled], np.pad(sigma**2 / n, (0, d - len(sigma))), vt.T, c


def check_whitening(spark, rows, k=32, columns=()):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in columns:
        d = d.withColumn(c, F.lit(c))
    kept = [(i, np.array(v, np.float32).tolist()) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    n, deviations, e, u, c = plainly_whitened([v for _, v in kept], 64, 1_000_000)
    got = whitening.whiten(d, components=k).collect()
    k = min(k, len(e))
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == Counter({p: m * k for p, m in Counter((i, v if v < 2**63 else None) for (i, _), v in zip(kept, deviations, strict=True)).items()})
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by = defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    assert sorted(by) == list(range(1, k + 1))
    for j in range(k):
        explained = {r["explained"] for r in by[j + 1]}
        assert len(explained) == 1
        if e[j] <= 1e-28 * max(e[0], 1e-300):
            assert explained == {0.0} and all(r["whitened"] is None for r in by[j + 1])
            continue
        assert math.isclose(explained.pop(), e[j] / e.sum(), rel_tol=1e-7)
        if min(abs(e[j] - x) for i, x in enumerate(e) if i != j) > 1e-3 * e[0]:
            want, have = sorted((str(i), z) for (i, _), z in zip(kept, c @ u[:, j] / np.sqrt(e[j]), strict=True)), sorted((str(r["vec_id"]), r["whitened"]) for r in by[j + 1])
            back = sorted((i, -z) for i, z in want)
            assert np.allclose([z for _, z in have], [z for _, z in want], atol=1e-7) or np.allclose([z for _, z in have], [z for _, z in back], atol=1e-7)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 12)) * (3.0 ** np.arange(12)) @ rng.normal(size=(12, 12))).tolist()
    odd = [(1, None), (2, [None] * 12), (3, [float("nan")] * 12), (4, [1.0] * 11 + [float("inf")]), (None, vectors[0]), (7, vectors[1]), (7, vectors[1]), (8, vectors[2][:5]), (9, [])]
    check_whitening(spark, [(10 + i, v) for i, v in enumerate(vectors)] + odd, columns=("x", "at", "n", "component", "r", "whitened"))
    check_whitening(spark, [(10 + i, v) for i, v in enumerate(vectors)], k=5)


def test_whitening_without_rank_and_of_large_entries(spark):
    rng = np.random.default_rng(6)
    flat = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 6)) * 1000
    check_whitening(spark, [(i, [*v, 5.0]) for i, v in enumerate(np.floor(flat).tolist())][:4])  # fewer rows than dimensions
    check_whitening(spark, [(i, [3.0, 3.0]) for i in range(5)])  # no variance at all
    check_whitening(spark, [(0, [1.0, 2.0])])
    wide = [[1e30, 0.0, -3e38], [2e7, 5e9, 1e37], [-1e30, 1.0, 3.0], [1.0, 2.0, 3.0]]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(wide)), "vec_id long, embedding array<float>")).collect()
    assert len(got) == 12 and got[0]["identity_error"] < 1e-4
    n, deviations, *_ = plainly_whitened(wide, 64, 1_000_000)
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, v if v < 2**63 else None) for i, v in enumerate(deviations)}
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")).collect() == []


def test_whitening_of_many_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "STACK", 1)
    rng = np.random.default_rng(7)
    check_whitening(spark, [(i, v) for i, v in enumerate((rng.normal(size=(90, 5)) * [9, 5, 3, 2, 1]).tolist())])


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (40, 7), (64, 64)])
def test_jacobi_keeps_small_singular_values(shape):
    rng = np.random.default_rng(8)
    r = rng.normal(size=shape) * 10.0 ** -np.arange(shape[1]).clip(0, 12)
    sigma, v = whitening.jacobi(r)
    assert np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-13)
    low = min(shape)
    assert np.allclose(sigma[:low], np.linalg.svd(r, compute_uv=False)[:low], rtol=1e-8, atol=1e-26)
    products = (r @ v).T @ (r @ v)
    size = np.sqrt(np.diag(products)) + 1e-300
    assert low < shape[1] or np.abs(products / np.outer(size, size) - np.eye(shape[1])).max() < 1e-8


def plain_trie(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, w in whole.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    ends = {k: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k)) for k, m in members.items()}
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


def conversations(seed=4):
    rng = random.Random(seed)
    rows = []
    for c in range(-12, 60):
        for t in range(rng.randrange(1, 10)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["é☃ yes", "no", None, "", f"own {c}"])))
    for c in range(100, 130):  # copies
        rows += [(c, t, "user" if t % 2 else "assistant", f"same {t}") for t in range(7)]
    rows += [(200, t, "user", f"long {t}") for t in range(400)]
    rows += [(201, 3, "user", "tie a"), (201, 3, "user", "tie b"), (201, 3, "user", "tie a"), (201, None, "user", "null turn"), (None, 1, "user", "no one"), (202, None, None, None)]
    rows += [(205, t, "user", "x" * 5000) for t in range(3)] + [(207, t, "user", "x" * 5000) for t in range(2)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def talks(spark):
    d = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    for c in ("depth", "size", "node", "part", "row", "at", "n"):
        d = d.withColumn(c, F.lit(c))
    return d


def trie_of(d):
    turns = trie.numbered_turns(d)
    out = trie.prefix_trie(*trie.rebuilt(turns, lambda c: c - c % 5, lambda c: F.crc32(c.cast("string")) % 9))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in out.collect())


def test_conversation_trie(talks):
    assert trie_of(talks) == plain_trie(conversations())


def test_conversation_trie_of_hot_groups_and_small_pieces(talks, monkeypatch):
    monkeypatch.setattr(skew, "BUCKET", 3)
    monkeypatch.setattr(skew, "MANY", 20)
    monkeypatch.setattr(trie, "PIECE", 8)
    assert trie_of(talks.repartition(5)) == plain_trie(conversations())


def test_conversation_trie_of_few_rows(spark):
    for rows in ([], [(None, 1, "user", "x")], [(7, 1, "user", "x")], [(6, t, "u", "x") for t in range(9)] + [(7, 0, "u", "x")]):
        assert trie_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == plain_trie(rows)


def test_turns_are_numbered_over_parts(spark):
    rows = [(1, t, "user", f"{t}") for t in range(3000)] + [(2, 0, "user", "x")] * 50
    turns = trie.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(16))
    got = Counter((r["conv_id"], r["depth"]) for r in turns.collect())
    assert got == Counter([(1, t + 1) for t in range(3000)] + [(2, t + 1) for t in range(50)])


def ascii_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_contamination(docs, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ascii_words(t)
        for s in range(max(len(w) - width, 0) + 1 if w else 0):
            windows[tuple(w[s : s + width])].add("" if i is None else str(i))
    out = Counter()
    for i, t in docs:
        w, hit, names = ascii_words(t), set(), set()
        for n in range(1, width + 1):
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    names |= found
        out[i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)] += 1
    return out


def leaks(seed=2):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(300)] + ["the"] * 200 + ["É", "ßx", "ABC"]
    text = lambda n: " ".join(rng.choice(pool) + rng.choice(["", ".", ",\n", "!"]) for _ in range(n))
    shared = text(25)
    items = [(i, text(rng.randrange(11, 40))) for i in range(30)] + [(100 + i, text(5) + " " + shared + " " + text(5)) for i in range(8)]
    items += [(200, "W5 w6"), (201, "zebra"), (202, None), (203, ""), (204, "... !!"), (205, "the " * 12), (None, "w7 w8 w9"), (3, text(15)), (206, items[0][1].upper()), (207, items[0][1]), (208, "the the"), (209, "ABC É ßx w1 w2 w3 w4 w5 w6 w7")]
    docs = [(i, text(rng.randrange(0, 120))) for i in range(80)]
    docs += [(100 + i, text(20) + " " + items[i][1].upper() + "; " + text(9)) for i in range(20)] + [(200 + i, text(3) + " - " + shared) for i in range(15)]
    docs += [(300, " ".join(ascii_words(items[2][1])[:9])), (301, " ".join(ascii_words(items[2][1])[1:12])), (302, None), (303, ""), (304, "the " * 500), (None, items[4][1]), (305, items[5][1]), (305, items[5][1]), (306, "abc É ßx w1 w2 w3 w4 w5 w6 w7"), (307, "abc é ßx w1 w2 w3 w4 w5 w6 w7"), (308, text(8000))]
    rng.shuffle(docs)
    return docs, items


@pytest.fixture(scope="module")
def leaking(spark):
    docs, items = leaks()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for c in ("row", "at", "term", "word", "words", "window", "pair", "n"):
        d, b = d.withColumn(c, F.lit(c)), b.withColumn(c, F.lit(c))
    return d, b


def judged(d, b):
    return Counter(tuple(r) for r in inverted.digest(inverted.contamination(inverted.build_index(d, b))).collect())


def test_contamination(leaking):
    want = plain_contamination(*leaks())
    assert judged(*leaking) == want and sum(k[-1] for k in want) > 40


def test_contamination_of_tables_too_large_for_broadcast(leaking, monkeypatch):
    """All joins by shuffle, hot terms and windows dealt out."""
    monkeypatch.setattr(inverted, "ROWS", 0)
    monkeypatch.setattr(inverted, "BUCKET", 20)
    monkeypatch.setattr(inverted, "MANY", 1000)
    assert judged(*leaking) == plain_contamination(*leaks())


def test_contamination_of_empty_tables(leaking):
    d, b = leaking
    assert judged(d.limit(0), b) == Counter()
    assert judged(d, b.limit(0)) == plain_contamination(leaks()[0], [])


@pytest.mark.parametrize("rows", [0, 200_000])
def test_proximity(leaking, monkeypatch, rows):
    monkeypatch.setattr(inverted, "ROWS", rows)
    docs, items = leaks()
    index = inverted.build_index(*leaking)
    ids = {r["row"]: r["doc_id"] for r in index.texts.collect()}
    got = {(ids[r["row"]], r["item"], r["at"]) for r in index.near_items(6).collect()}
    counts = Counter(w for _, t in docs for w in ascii_words(t))
    terms = {r["at"]: r for r in index.postings.collect()}
    assert terms
    want = set()
    for i, t in docs:
        w = ascii_words(t)
        for item, text in items:
            bag = set(ascii_words(text))
            if not bag or any(not counts[x] for x in bag):
                continue
            low = min(counts[x] for x in bag)
            spots = [[k for k in range(len(w)) if w[k] == x and all(any(w[j] == y for j in range(max(0, k - 6), k + 7) if j < len(w)) for y in bag)] for x in bag if counts[x] == low]
            want |= {(i, "" if item is None else str(item), k) for k in (spots[0] if len(spots) == 1 else [])}
            got -= {g for g in got if g[1] == ("" if item is None else str(item)) and len(spots) > 1}
    assert got == want and want


def test_native_operator_has_no_python_in_its_plan(spark, sf_dir):
    plan = queries.op13_benchmark_decontamination(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|MapInPandas|Deserialize", plan)
