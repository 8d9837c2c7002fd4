"""What one large value may cost: many matches in a text, many segments of one minimizer, components and lengths of any size."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import packing, secrets, suffix, topk


def some_spans(text):
    """(kind, start, end) of the base spans and of long runs that meet none of them, plainly."""
    base = []
    for kind, pattern, group, least in secrets.KINDS[:3]:
        base += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    owned = [(m.start(), "owned", m.end()) for m in re.finditer(secrets.OWNED, text) if len(set(m[0])) >= secrets.VARIED and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return Counter(base), Counter(s for s in owned if not any(b[0] < s[2] and s[0] < b[2] for b in base))


@pytest.mark.parametrize("unit", [1, 3, 64])
def test_spans_of_texts_of_many_matches(spark, monkeypatch, unit):
    monkeypatch.setattr(secrets, "UNIT", unit)
    rng = random.Random(unit)
    word = lambda k, pool: "".join(rng.choice(pool) for _ in range(k))
    some = lambda: rng.choice([word(18, "0123456789abcdef"), "AKIA" + word(16, "ABCDEFG012"), "token=" + word(14, "abcXYZ019._-"), word(26, "abcdefghXYZ0123456789/+"), "secret: " + word(5, "abc"), "word é", "key=" + ".".join(word(17, "0123456789abcdef") for _ in range(3)), "password=" + ".".join(word(17, "0123456789abcdef") for _ in range(4))])
    texts = [" ".join(some() for _ in range(n)) for n in (0, 1, 2, 5, 70, 200)] + [None]
    d = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = secrets._candidates(d, F.col("text"), F.col("source"), F.col("source"), F.col("doc_id")).collect()
    for r in found:
        base, further = some_spans(texts[r["doc_id"]] or "")
        assert Counter((s["start"], s["kind"], s["end"]) for s in r["_base"]) == base
        assert Counter((s["start"], s["kind"], s["end"]) for s in r["_further"]) == further
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_live(d, F.col("source"), F.col("source")).collect()}
    for i, t in enumerate(texts):
        base, further = some_spans(t or "")
        out, at = [], 0
        for a, _, b in sorted([*base, *further]):
            if a >= at:
                out += [t[at:a], secrets.MARK]
            at = max(at, b)
        assert clean[i] == (None if t is None else "".join([*out, t[at:]]))


def test_a_text_of_sixty_thousand_matches(spark):
    """The fold that appended to one array took the square of its matches."""
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(16)) for _ in range(60_000))
    d = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    secrets.digest(secrets.scan_secrets(d.limit(0), F.col("source"), F.col("source"))).collect()
    began = time.monotonic()
    assert secrets.digest(secrets.scan_secrets(d, F.col("source"), F.col("source"))).first()["n_hex"] == 60_000
    assert time.monotonic() - began < 60


def test_a_minimizer_of_very_many_segments_is_hot(spark, monkeypatch):
    """Segments of one key are counted in 32 bits; one text has 88 507 of a key."""
    monkeypatch.setattr(suffix, "HOT", 70_000)
    asked = []
    windows = suffix.Block.windows
    monkeypatch.setattr(suffix.Block, "windows", lambda self, hot, *a: (asked.append(len(hot)), windows(self, hot, *a))[1])
    counts = np.array([65_535, 65_536, 88_507], np.uint32)
    from loomwright.llm import blocks as B

    assert B.unpack(B.pack(counts)).astype(np.int64).tolist() == counts.tolist()
    rng = random.Random(2)
    phrase = "the very same words in each line, "
    text = "".join(phrase + str(rng.randrange(10**9)) + "\n" for _ in range(2000))
    d = spark.createDataFrame([(1, text), (2, text[:3000]), (3, "x" * 60 + phrase * 3)], "doc_id long, text string")
    usual = Counter(map(str, suffix.remove_repeated_strings(d).collect()))
    monkeypatch.setattr(suffix, "HOT", 50)
    assert Counter(map(str, suffix.remove_repeated_strings(d).collect())) == usual


def test_products_of_components_of_any_size(spark):
    rows = [(0, [2e7, 1.0, -3.0]), (1, [1.5e7, 2.0, 5e5]), (2, [-2e7, 0.0, 1.0]), (50, [1e300, -1e300, 1.7e308]), (3, [4e9, 1e10, 0.25]), (4, [1.0, 2.0, 3.0]), (100, [0.5, 0.25, -0.125]), (5, [float("inf"), 0.0, 0.0]), (6, [1e9, 1e9, 1e9])]

    def plainly(rows, k=5):
        whole = lambda x: max(-topk.LARGEST, min(topk.LARGEST, int(np.floor(x * 256)) if abs(x * 256) < 1e300 else (topk.LARGEST if x > 0 else -topk.LARGEST)))
        v = {i: [whole(x) for x in e] for i, e in rows if all(np.isfinite(e))}
        clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        out = set()
        for q in v:
            if q % 50 == 0:
                scores = sorted((-clip(sum(a * b for a, b in zip(v[q], v[i], strict=True))), i) for i in v if i != q)[:k]
                out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
        return out

    for some in (rows, [r for r in rows if r[0] in (0, 1, 2, 4, 100)]):
        d = spark.createDataFrame(some, "vec_id long, embedding array<double>")
        assert {tuple(r) for r in topk.top_products(d, d.where("vec_id % 50 = 0"), k=5, scale=256).collect()} == plainly(some)


LENGTHS = {
    "normal400": lambda r: r.gauss(400, 120), "normal500": lambda r: r.gauss(500, 100), "normal340": lambda r: r.gauss(341, 3), "normal512": lambda r: r.gauss(512, 30), "normal600": lambda r: r.gauss(600, 200),
    "lognormal5.8": lambda r: r.lognormvariate(5.8, 0.6), "lognormal5.5": lambda r: r.lognormvariate(5.5, 1.2), "lognormal6.5": lambda r: r.lognormvariate(6.5, 0.8), "lognormal4": lambda r: r.lognormvariate(4, 1),
    "uniform": lambda r: r.uniform(1, 1024), "uniform400": lambda r: r.uniform(400, 624), "uniform600": lambda r: r.uniform(600, 1024), "uniform200": lambda r: r.uniform(1, 200), "exponential": lambda r: r.expovariate(1 / 300),
    "two humps": lambda r: r.gauss(300, 40) if r.random() < 0.5 else r.gauss(700, 40), "halves": lambda r: r.choice([512, 512, 511, 513, 100]), "thirds": lambda r: r.choice([341, 342, 340, 683, 20]), "full": lambda r: r.choice([1024, 1024, 1000, 24, 25]),
    "triangle": lambda r: r.triangular(1, 1024, 900), "powers": lambda r: 2 ** r.randrange(11),
}


@pytest.mark.parametrize("name", LENGTHS)
def test_packing_needs_no_more_than_best_fit(name):
    rng = random.Random(name)
    histogram = Counter(min(1024, max(1, int(LENGTHS[name](rng)))) for _ in range(12_000))
    began = time.monotonic()
    plan, bins = packing.pack_plan(dict(histogram))
    assert time.monotonic() - began < 30
    assert bins <= packing.pack_plan(dict(histogram), small=0.5)[1]
    placed = Counter()
    for p in plan:
        placed[p.length] += p.count
    assert placed == histogram
    used = Counter()
    for p in plan:
        for k in range(p.count):
            used[p.bin + k // p.each] += p.length
    assert len(used) == bins and max(used.values()) <= 1024


def test_pricing_of_two_pieces_equals_the_knapsack():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = np.sort(rng.choice(np.arange(342, 1025), 30, replace=False))[::-1]
        prices = rng.random(30) * sizes
        gain, new = packing.price(sizes, prices, 1024)
        most = max([prices[i] for i in range(30)] + [prices[i] + prices[j] for i in range(30) for j in range(30) if sizes[i] + sizes[j] <= 1024])
        assert np.isclose(gain, most) and np.isclose((new * prices).sum(), most) and (new * sizes).sum() <= 1024
