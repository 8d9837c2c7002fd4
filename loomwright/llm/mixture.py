"""Mixing sources to target weights, by hierarchical budgeting.

Weights run down a tree (domain, language, source). Each node's budget is
dealt to its children by weight; a child that cannot use its share (tokens of
its subtree times the allowed epochs) takes what it has, and the rest goes to
its siblings by weight. Only what a whole subtree cannot use goes up. The tree
is the table of leaves, summed in the cluster; it has as many rows as there
are sources, and the budgets are made from it on the driver.

A leaf's tokens are ordered by a seeded hash, anew in each epoch. Selecting the
prefix needs no sort of a leaf and no shuffle of texts: token sums of ranges of
the hash show in which range the budget ends, and that range is cut again in
the same way. Rows before the last one are taken where they are; only the rows
in it, some millionth of a leaf, are put in order. The document at the cut is
taken in part (take_tokens).

Defined results: null labels are the label ''; null or empty texts have no
tokens and are never taken; equal hashes are ordered by id and text; repeated
rows are rows of their own; weights that are missing are DEFAULT_WEIGHT, and a
weight of 0 takes nothing; other columns are kept, whatever their names; an
empty table gives none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.sources.shared import written

#: Bits of the hash that make a range, and how often a range is cut again: a leaf has 2 ** (BITS * LEVELS) ranges in all.
BITS = 10
LEVELS = 2
#: Most leaves that the driver deals budgets to (more are an error), and most rows of the plan that are broadcast.
LEAVES = 500_000
BROADCAST = 100_000
DEFAULT_WEIGHT = 1.0
Path = tuple[str, ...]


def deal(amount: int, children: Mapping[str, tuple[float, int]]) -> dict[str, int]:
    """Whole shares of amount by weight, none over its capacity; what one cannot use goes to the others. children: weight, capacity."""
    out = dict.fromkeys(children, 0)
    open_ = {k: w for k, (w, cap) in sorted(children.items()) if w > 0 and cap > 0}
    left = amount
    while open_ and left > 0:
        total = sum(open_.values())
        full = [k for k, w in open_.items() if out[k] + left * w / total >= children[k][1]]
        if full:
            share = {k: left * open_[k] / total for k in full}
            for k in full:
                take = children[k][1] - out[k]
                out[k] += take
                left -= take
                del open_[k]
            if left < 0:  # by rounding
                k = max(full, key=lambda f: (share[f], f))
                out[k] += left
                left = 0
            continue
        exact = {k: left * w / total for k, w in open_.items()}
        whole = {k: int(x) for k, x in exact.items()}
        rest = left - sum(whole.values())
        for k in sorted(open_, key=lambda k: (whole[k] - exact[k], k))[:rest]:
            whole[k] += 1
        for k, n in whole.items():
            out[k] += n
        left = 0
    return out


def budgets(leaves: Mapping[Path, int], weights: Mapping[Path, float], total: int, epochs: int) -> dict[Path, int]:
    """Tokens for each leaf. leaves: tokens by path; weights: of any node, by its path."""
    capacity: dict[Path, int] = defaultdict(int)
    below: dict[Path, set[Path]] = defaultdict(set)
    for leaf, tokens in leaves.items():
        for k in range(len(leaf) + 1):
            capacity[leaf[:k]] += tokens * epochs
            if k:
                below[leaf[: k - 1]].add(leaf[:k])
    out: dict[Path, int] = {}
    todo = [((), min(total, capacity[()]))]
    while todo:
        node, amount = todo.pop()
        if node in leaves:
            out[node] = amount
            continue
        shares = deal(amount, {c[-1]: (weights.get(c, DEFAULT_WEIGHT), capacity[c]) for c in below[node]})
        todo += [((*node, name), n) for name, n in shares.items()]
    return out


def count_words(text: str = "text") -> Column:
    """Tokens as whitespace-delimited words."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _free(name: str, taken: Sequence[str]) -> str:
    """name, with more underscores in front while a column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def _bucket(order: Column, level: int) -> Column:
    """The level-th BITS of a hash, as an unsigned number."""
    return F.shiftrightunsigned(order, 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _cut(rows: DataFrame, cuts: DataFrame, level: int) -> DataFrame:
    """cuts (_leaf, _epoch, _quota, _before), each with the range of the next BITS in which the quota ends, and the tokens before it.

    A row more at the end of each stands for a quota that takes all.
    """
    by = ["_leaf", "_epoch"]
    sums = rows.groupBy(*by, _bucket(F.col("_order"), level).alias("_range")).agg(F.sum("_tokens").alias("_in"))
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # 1 << BITS rows at most
    placed = sums.withColumn("_in_before", F.coalesce(F.sum("_in").over(w), F.lit(0))).join(cuts, by)
    ends = placed.where((F.col("_before") + F.col("_in_before") < F.col("_quota")) & (F.col("_before") + F.col("_in_before") + F.col("_in") >= F.col("_quota")))
    return ends.select(*cuts.columns[:-1], (F.col("_before") + F.col("_in_before")).alias("_before"), F.col("_range").alias(f"_cut{level}")).select(*cuts.columns[:-1], f"_cut{level}", "_before")


def mix_sources(
    docs: DataFrame, levels: Sequence[Column], weights: Mapping[Path, float], fraction: float, epochs: int = 1, seed: int = 0,
    tokens: Column | None = None, doc_id: str = "doc_id", text: str = "text", told: bool = True,
) -> DataFrame:
    """The rows of docs that the budgets take, one for each epoch that takes tokens of the document.

    fraction: of all tokens, the total to take. told: with columns _leaf (labels), _epoch, _tokens and _take beside those of docs
    (with more underscores in front where docs has such a column); otherwise docs' columns only.
    """
    tokens = count_words(text) if tokens is None else tokens
    leaf = F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in levels))
    spark = docs.sparkSession
    hashed = [leaf.alias("_leaf"), tokens.alias("_tokens"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("_text_hash")]
    narrow = written(docs.select(*hashed).where("_tokens > 0"), "mixture")
    by_leaf = narrow.groupBy("_leaf").agg(F.sum("_tokens").alias("n")).limit(LEAVES + 1).collect()
    if len(by_leaf) > LEAVES:
        raise ValueError(f"over {LEAVES} leaves: group small sources under a level of their own")
    sums = {tuple(r["_leaf"]): r["n"] for r in by_leaf}
    share = budgets(sums, weights, int(sum(sums.values()) * fraction), epochs)
    plan = [(list(k), e, min(sums[k], v - e * sums[k])) for k, v in share.items() for e in range(-(-v // sums[k]) if v else 0)]
    cuts = spark.createDataFrame(plan, "_leaf array<string>, _epoch int, _quota long").withColumn("_before", F.lit(0).cast("long"))
    small = F.broadcast if len(plan) <= BROADCAST else (lambda d: d)
    order = F.xxhash64(F.lit(seed), "_epoch", "_text_hash").alias("_order")
    inside = F.lit(True)
    for level in range(LEVELS):
        rows = narrow.join(small(cuts), "_leaf").select("*", order).where(inside)
        cuts = written(_cut(rows.select("_leaf", "_epoch", "_tokens", "_order"), cuts, level), "cuts")
        inside = inside & (_bucket(F.col("_order"), level) == F.col(f"_cut{level}"))
    names = {f"_own{k}": c for k, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(c).alias(n) for n, c in names.items()), *hashed).join(small(cuts), "_leaf").select("*", order)
    below, same = F.lit(False), F.lit(True)
    for level in range(LEVELS):
        below = below | (same & (_bucket(F.col("_order"), level) < F.col(f"_cut{level}")))
        same = same & (_bucket(F.col("_order"), level) == F.col(f"_cut{level}"))
    extra = ["_leaf", "_epoch", "_tokens", "_take"]
    whole = rows.where(below & (F.col("_tokens") > 0)).withColumn("_take", F.col("_tokens"))
    # only the range at the cut is put in order; signed and unsigned order agree within it
    w = Window.partitionBy("_leaf", "_epoch").orderBy("_order", "_id", "_text_hash").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(same).where("_tokens > 0")
    edge = edge.withColumn("_take", F.least(F.col("_tokens"), F.col("_quota") - F.col("_before") - F.coalesce(F.sum("_tokens").over(w), F.lit(0)))).where("_take > 0")
    out = whole.select(*names, *extra).unionByName(edge.select(*names, *extra))
    return out.select(*(F.col(n).alias(c) for n, c in names.items()), *(F.col(c).alias(_free(c, docs.columns)) for c in extra if told))


#: Domains by the number at a source's end, and the weights of the tree that the queries use.
DOMAINS = ("web", "news", "books", "code")
WEIGHTS: dict[Path, float] = {("web",): 0.4, ("news",): 0.25, ("books",): 0.2, ("code",): 0.15} | {(d, "en"): 3.0 for d in DOMAINS}


def document_levels() -> list[Column]:
    """domain, language, source of the documents table."""
    number = F.coalesce(F.try_element_at(F.regexp_extract_all("source", F.lit(r"([0-9]+)$"), F.lit(1)), F.lit(1)), F.lit("0"))
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (F.pmod(F.conv(F.right(number, F.lit(6)), 10, 10).cast("int"), F.lit(len(DOMAINS))) + 1).cast("int"))
    return [domain, F.col("lang"), F.col("source")]
