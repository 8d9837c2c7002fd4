"""Quota-constrained, diversity-aware selection.

The cluster reduces the candidates to what a sequential choice can still use
(a repository is a function of the instance):

* What a pick changes is equal for all pairs of one (model, bands, repository),
  so only the best `quota` of each can be picked. Picks touch as many
  repositories as there are; a pair of a repository whose best pair is behind
  those of more repositories than that is beaten by an untouched one.
* For diversity picks the same holds of (target, model, band, repository), with
  the best row of each instance. Further rows of an instance count only where
  a (target, model) may run out of instances, and then these are few.

That rest stays in the cluster, ranked, as a written table. The choice runs on
the driver, which holds the first rows of the first repositories of each
stratum (GROUPS, DEPTH) and, for the repositories that it doesn't hold, the
best score that one of them has. A pick is certain if it beats that score with
the largest bonus that a repository can get; only if it doesn't, or if what is
held of a repository is used up, the cluster is asked for more, twice as many
each time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.sources.shared import discard, written

# --- fixed values ---
PAIR_QUOTAS = {"70b": 87, "8b": 25, "405b": 13}
TOTAL_QUOTAS = {"70b": 175, "8b": 50, "405b": 25}
SEED = 20260814
BAND_SHARES = {"10-19": 0.4, "20-39": 0.4, "40+": 0.2}

#: Repositories of a stratum, and rows of a repository, that the driver asks for at first.
GROUPS = 48
DEPTH = 4
#: What float sums in another order may differ by.
SLACK = 1e-9


@dataclass(frozen=True)
class Quotas:
    pairs: Mapping[str, int]
    totals: Mapping[str, int]
    seed: int = SEED


def paired_capacity(candidates: DataFrame) -> DataFrame:
    """Distinct instances of each model that have both outcomes; 0 for a model that has none."""
    both = candidates.groupBy("model_short", "instance_id").agg(F.when(F.min("target") != F.max("target"), 1).otherwise(0).alias("pair"))
    return both.groupBy("model_short").agg(F.sum("pair").cast("long").alias("capacity"))


def fit_quotas(capacity: Mapping[str, int], preferred: Mapping[str, int], total: int) -> dict[str, int]:
    """Preferred quotas within capacity; the rest goes one by one where most room is left."""
    out = {m: min(n, capacity.get(m, 0)) for m, n in preferred.items()}
    if sum(out.values()) > total or sum(capacity.get(m, 0) for m in preferred) < total:
        raise ValueError(f"no quotas of {total} pairs within {dict(capacity)}")
    for _ in range(total - sum(out.values())):
        m = max((m for m in out if out[m] < capacity.get(m, 0)), key=lambda m: (capacity.get(m, 0) - out[m], preferred[m], m))
        out[m] += 1
    return out


def pair_options(candidates: DataFrame, seed: int = SEED) -> DataFrame:
    """The best success and the best failure of each (instance, model), with the pair's fixed score."""
    w = Window.partitionBy("instance_id", "model_short", "target").orderBy(F.desc("quality_score"), T.stable_jitter(F.col("uid"), seed).desc(), "uid")
    best = candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    side = lambda t: best.where(F.col("target") == t).select("instance_id", "model_short", "repository", F.struct("uid", "quality_score", "length_band").alias("success" if t else "failure"))
    pairs = side(True).join(side(False).drop("repository"), ["instance_id", "model_short"])
    differ = F.when(F.col("success.length_band") != F.col("failure.length_band"), 2.0).otherwise(0.0)
    return pairs.withColumn("score", F.col("success.quality_score") + F.col("failure.quality_score") + differ + T.stable_jitter(F.col("instance_id"), seed))


def _top(d: DataFrame, keys: list[str], order: list, n: int | Column, name: str) -> DataFrame:
    return d.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def _of_best_repositories(d: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The rows of those n repositories, for each of keys, whose first rows are best."""
    best = _top(_top(d, [*keys, "repository"], order, 1, "_one"), keys, order, n, "_place").select(*keys, "repository")
    return d.join(best, [*keys, "repository"], "left_semi")


def _by_model(counts: Mapping[str, int]) -> Column:
    out = F.lit(0)
    for m, n in counts.items():
        out = F.when(F.col("model_short") == m, n).otherwise(out)
    return out


def pair_contenders(options: DataFrame, quotas: Quotas) -> DataFrame:
    """The pair options that the choice of pairs can reach."""
    d = options.where(F.col("model_short").isin(*quotas.pairs)).withColumn("_t", F.col("success.length_band")).withColumn("_f", F.col("failure.length_band"))
    order = [F.desc("score"), "instance_id"]
    d = _of_best_repositories(d, ["model_short", "_t", "_f"], order, sum(quotas.pairs.values()) + 1)
    return _top(d, ["model_short", "_t", "_f", "repository"], order, _by_model(quotas.pairs), "_r").drop("_t", "_f", "_r")


def diversity_contenders(candidates: DataFrame, quotas: Quotas) -> DataFrame:
    """The rows that the diversity picks can reach, with jitter."""
    pairs, totals = quotas.pairs, quotas.totals
    picks = sum(2 * totals[m] for m in totals)
    d = candidates.where(F.col("model_short").isin(*totals)).withColumn("jitter", T.stable_jitter(F.col("uid"), quotas.seed))
    order = [(F.col("quality_score") + F.col("jitter")).desc(), "uid"]
    used = _by_model({m: 2 * totals[m] - pairs.get(m, 0) for m in totals})  # instances that a model's picks use at most
    one = _top(d, ["target", "model_short", "length_band", "instance_id"], order, 1, "_r")
    many = _of_best_repositories(one, ["target", "model_short", "length_band"], order, picks + 1)
    many = _top(many, ["target", "model_short", "length_band", "repository"], order, used + 1, "_k").drop("_k")
    scarce = d.groupBy("target", "model_short").agg(F.count_distinct("instance_id").alias("n")).where(F.col("n") <= used).select("target", "model_short")
    rest = _top(d.join(F.broadcast(scarce), ["target", "model_short"], "left_semi"), ["target", "model_short", "length_band", "instance_id"], order, _by_model(totals) + 1, "_r")
    return many.where("_r = 1").unionByName(rest.where("_r > 1")).unionByName(rest.where("_r = 1").join(many, "uid", "left_anti")).drop("_r")


def select(candidates: DataFrame, quotas: Quotas) -> DataFrame:
    """Paired picks, then diversity picks. candidates: uid, instance_id, repository, model_short, target, quality_score, length_band."""
    return selected_with_cost(candidates, quotas)[0]


def selected_with_cost(candidates: DataFrame, quotas: Quotas) -> tuple[DataFrame, int]:
    """The selection, and how many rows the driver took for it."""
    if any(n > quotas.totals.get(m, 0) for m, n in quotas.pairs.items()):
        raise ValueError("more pairs than rows asked of a model")
    options = pair_contenders(pair_options(candidates, quotas.seed), quotas).withColumn("good", F.col("success.length_band")).withColumn("bad", F.col("failure.length_band"))
    pairs = Held(options, ["model_short", "good", "bad"], [F.desc("score"), "instance_id"], lambda r: r["score"])
    chosen, state = choose_pairs(pairs, quotas)
    rows = Held(diversity_contenders(candidates, quotas), ["target", "model_short", "length_band"], [(F.col("quality_score") + F.col("jitter")).desc(), "uid"], lambda r: r["quality_score"] + r["jitter"])
    chosen += choose_diverse(rows, quotas, state)
    out = candidates.sparkSession.createDataFrame(chosen, "uid string, selection_group string, pair_id string").join(candidates, "uid")
    for held in (pairs, rows):
        held.close()
    return out, pairs.collected + rows.collected


class Held:
    """Ranked rows of the cluster, of which the driver holds a part: by stratum and repository, best first."""

    def __init__(self, rows: DataFrame, strata: list[str], order: list, score):
        group = [*strata, "repository"]
        w = Window.partitionBy(*group)
        d = rows.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
        first = d.where("_k = 1").withColumn("_place", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).select(*group, "_place")
        self.table = written(d.join(first, group), "ranked")
        self.strata, self.score, self.collected = strata, score, 0
        self.rows: dict[tuple, dict[str, list[dict]]] = {}
        self.count: dict[tuple, int] = {}  # rows of a (stratum, repository) in the cluster
        self.bound: dict[tuple, float] = {}  # the best score beyond what is held, of strata that have more
        self.places: dict[tuple, int] = {}
        self._take(((F.col("_place") <= GROUPS) & (F.col("_k") <= DEPTH)) | ((F.col("_place") == GROUPS + 1) & (F.col("_k") == 1)))

    def _take(self, which: Column) -> None:
        for r in sorted((r.asDict(recursive=True) for r in self.table.where(which).collect()), key=lambda r: (r["_place"], r["_k"])):
            self.collected += 1
            stratum = tuple(r[c] for c in self.strata)
            self.places.setdefault(stratum, GROUPS)
            if r["_place"] > self.places[stratum]:
                self.bound[stratum] = self.score(r)
            else:
                self.rows.setdefault(stratum, {}).setdefault(r["repository"], []).append(r)
                self.count[*stratum, r["repository"]] = r["_n"]

    def _of(self, stratum: tuple) -> Column:
        which = F.lit(True)
        for c, v in zip(self.strata, stratum, strict=True):
            which = which & F.col(c).eqNullSafe(F.lit(v))
        return which

    def of(self, part: tuple) -> list[tuple]:
        """The strata whose first columns are these."""
        return [s for s in self.places if s[: len(part)] == part]

    def more_repositories(self, stratum: tuple) -> None:
        had = self.places[stratum]
        self.places[stratum] = 2 * had
        self.bound.pop(stratum)
        self._take(self._of(stratum) & (F.col("_place") > had) & (((F.col("_place") <= 2 * had) & (F.col("_k") <= DEPTH)) | ((F.col("_place") == 2 * had + 1) & (F.col("_k") == 1))))

    def first(self, stratum: tuple, repository: str, good) -> dict | None:
        """The first row of a held repository that is good; what isn't held of it is asked for only if nothing held is."""
        held = self.rows[stratum][repository]
        at = 0
        while True:
            for k in range(at, len(held)):
                if good(held[k]):
                    return held[k]
            at = len(held)
            if at >= self.count[*stratum, repository]:
                return None
            self._take(self._of(stratum) & F.col("repository").eqNullSafe(F.lit(repository)) & (F.col("_k") > at) & (F.col("_k") <= 2 * at + DEPTH))

    def close(self) -> None:
        discard(self.table)


@dataclass
class State:
    uids: set[str]
    instances: set[tuple[str, str]]  # of a model
    repositories: Counter
    bands: dict[bool, Counter]


def _models(quotas: Quotas) -> list[str]:
    return sorted(quotas.pairs, key=lambda m: (quotas.pairs[m], m))


def _certain(held: Held, strata: list[tuple], worth: float, beyond) -> bool:
    """Whether no repository that isn't held can be worth as much; the strata that may have one are asked for more."""
    open_ = [s for s in strata if s in held.bound and beyond(s, held.bound[s]) >= worth - SLACK * (1 + abs(worth))]
    for s in open_:
        held.more_repositories(s)
    return not open_


def choose_pairs(held: Held, quotas: Quotas) -> tuple[list[tuple], State]:
    """Pick by pick, smaller quotas first; each pick changes what the next is worth. Only the first of equal standing is looked at."""
    state, chosen = State(set(), set(), Counter(), {True: Counter(), False: Counter()}), []
    for model in _models(quotas):
        strata = held.of((model,))
        bands = lambda s: 3.0 / (1 + state.bands[True][s[1]]) + 3.0 / (1 + state.bands[False][s[2]])
        for _ in range(quotas.pairs[model]):
            while True:
                free = lambda o: (o["model_short"], o["instance_id"]) not in state.instances
                heads = {(s, r): o for s in strata for r in list(held.rows.get(s, {})) if (o := held.first(s, r, free))}
                few = {k: o for k, o in heads.items() if state.repositories[k[1]] <= 2}
                worth = lambda k, o: o["score"] + 3.0 / (1 + state.bands[True][k[0][1]]) + 3.0 / (1 + state.bands[False][k[0][2]]) + 2.0 / (1 + state.repositories[k[1]])
                some = few or heads
                best = min(some, key=lambda k: (-worth(k, some[k]), -some[k]["score"], some[k]["instance_id"]), default=None)  # noqa: B023
                # beyond the first tier only if no repository that isn't held can be in it
                if _certain(held, strata, worth(best, some[best]) if few else float("-inf"), lambda s, b: b + bands(s) + 2.0):
                    break
            if best is None:
                raise ValueError(f"too few pairs of model {model}")
            o, pair = some[best], f"P{len(chosen) // 2 + 1:02d}"
            for target, side in ((True, o["success"]), (False, o["failure"])):
                chosen.append((side["uid"], "paired", pair))
                state.uids.add(side["uid"])
                state.bands[target][side["length_band"]] += 1
            state.instances.add((model, o["instance_id"]))
            state.repositories[o["repository"]] += 2
    return chosen, state


def wanted_bands(quotas: Quotas) -> dict[str, int]:
    """Rows of each length band that either outcome should have; the last band takes what rounding leaves."""
    size = sum(quotas.totals.values())
    first = {b: round(size * share) for b, share in list(BAND_SHARES.items())[:-1]}
    return first | {list(BAND_SHARES)[-1]: size - sum(first.values())}


def choose_diverse(held: Held, quotas: Quotas, state: State) -> list[tuple]:
    """Fill each (target, model) up to its total, towards the shares of the bands: from unused instances of little-used
    repositories, else from unused instances, else from any unused row."""
    chosen, wanted = [], wanted_bands(quotas)
    for target in (True, False):
        for model in _models(quotas):
            strata = held.of((target, model))
            short = lambda s: min(max(wanted.get(s[2], 0) - state.bands[s[0]][s[2]], 0), 8) * 2.0
            worth = lambda k, r: r["quality_score"] + short(k[0]) + 2.0 / (1 + state.repositories[k[1]]) + r["jitter"]
            fresh = lambda r: (r["model_short"], r["instance_id"]) not in state.instances and r["uid"] not in state.uids
            unused = lambda r: r["uid"] not in state.uids
            for _ in range(quotas.totals[model] - quotas.pairs.get(model, 0)):
                while True:
                    heads = {(s, p): r for s in strata for p in list(held.rows.get(s, {})) if (r := held.first(s, p, fresh))}
                    first = {k: r for k, r in heads.items() if state.repositories[k[1]] < 4}
                    tier = first or heads
                    best = min(tier, key=lambda k: (-worth(k, tier[k]), tier[k]["uid"]), default=None)  # noqa: B023
                    if _certain(held, strata, worth(best, tier[best]) if first else float("-inf"), lambda s, b: b + short(s) + 2.0):  # noqa: B023
                        break
                if best is None:
                    tier = {(s, p): r for s in strata for p in list(held.rows.get(s, {})) if (r := held.first(s, p, unused))}
                    best = min(tier, key=lambda k: (-worth(k, tier[k]), tier[k]["uid"]), default=None)  # noqa: B023
                if best is None:
                    raise ValueError(f"too few rows of model {model}, target {target}")
                r = tier[best]
                chosen.append((r["uid"], "diversity", ""))
                state.uids.add(r["uid"])
                state.instances.add((model, r["instance_id"]))
                state.repositories[r["repository"]] += 1
                state.bands[target][r["length_band"]] += 1
    return chosen


def numbered(selected: DataFrame) -> DataFrame:
    """selection_id CASE-0001, ...: pairs first, by pair_id as text, success before failure. The selection is a few hundred rows."""
    w = Window.orderBy(F.when(F.col("selection_group") == "paired", 0).otherwise(1), "pair_id", F.col("target").desc(), "model_short", "uid")
    return selected.withColumn("selection_id", F.format_string("CASE-%04d", F.row_number().over(w)))


def summary(selected: DataFrame) -> DataFrame:
    """Counts by group, model, band and target, and by target with model and band, with what is distinct and the scores' range, in one pass."""
    sets = selected.groupingSets([["target"], ["selection_group"], ["model_short"], ["length_band"], ["target", "model_short"], ["target", "length_band"], []], "target", "selection_group", "model_short", "length_band")
    return sets.agg(
        F.count("*").alias("n"), F.count_distinct("instance_id").alias("instances"), F.count_distinct("repository").alias("repositories"),
        F.min("quality_score").alias("least"), F.max("quality_score").alias("most"), F.avg("quality_score").alias("mean"),
    )


def summary_json(selected: DataFrame, seed: int, eligible: int) -> dict:
    """The summary of a selection as one object (counts by label: as many as there are labels)."""
    rows = summary(selected).collect()
    name = lambda v: str(v).lower() if isinstance(v, bool) else v

    def counts(*keys):
        return {tuple(name(r[k]) for k in keys): r["n"] for r in rows if all((r[k] is not None) == (k in keys) for k in ("target", "selection_group", "model_short", "length_band"))}

    def nested(key):
        out: dict[str, dict] = {"true": {}, "false": {}}
        for (t, v), n in counts("target", key).items():
            out[t][v] = n
        return out

    whole = next((r for r in rows if all(r[k] is None for k in ("target", "selection_group", "model_short", "length_band"))), None)
    flat = lambda key: {k: n for (k,), n in counts(key).items()}
    return {
        "seed": seed, "eligible_candidate_count": eligible, "selected_count": whole["n"] if whole else 0,
        "target_counts": flat("target"), "selection_group_counts": flat("selection_group"), "model_counts": flat("model_short"), "length_band_counts": flat("length_band"),
        "model_counts_by_target": nested("model_short"), "length_band_counts_by_target": nested("length_band"),
        "unique_instance_ids": whole["instances"] if whole else 0, "unique_repositories": whole["repositories"] if whole else 0,
        "quality_score": {"min": whole["least"], "max": whole["most"], "mean": round(whole["mean"], 3)} if whole else {},
    }
