"""Curation of intent-action data: short actions, review, groups and splits, hard negatives (derived from a design, not from code)."""

from __future__ import annotations

import json
import shlex
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomwright.functions import text as T
from loomwright.operators import skew
from loomwright.operators.graph import components
from loomwright.sources.shared import written

SPLITS = (("train", 0.70), ("validation", 0.15), ("test", 0.15))
REVIEW_LABELS = ("direct_match", "partial_match", "no_match", "ambiguous", "invalid")


def one_to_one(steps: DataFrame) -> DataFrame:
    """Successful steps with exactly one intent and one action."""
    return steps.where((F.col("status") == "success") & (F.size("intents") == 1) & (F.size("actions") == 1))


def unfulfilled(steps: DataFrame) -> DataFrame:
    return steps.where((F.size("intents") == 1) & (F.size("actions") == 0))


def short_action_reasons(action: Column, payload: Column) -> Column:
    """Why an action is not short; empty for a short one."""
    reasons = {
        "edit": T.action_phase(action) == "edit", "heredoc": action.rlike(r"<<-?\s*['\"]?\w+"), "multiline": F.instr(T.strip(action), "\n") > 0,
        "patch": action.contains("diff --git") | action.contains("@@ "), "payload": T.approximate_tokens(payload) > 64, "total": T.approximate_tokens(action) > 128,
    }
    return F.filter(F.array(*(F.when(c, n) for n, c in reasons.items())), lambda x: x.isNotNull())


def stable_id(source: Column, trajectory: Column, step: Column, sequence: Column) -> Column:
    return F.concat(source, F.lit(":"), trajectory, F.lit(":T"), step.cast("string"), F.lit("-I"), sequence.cast("string"))


def annotation_queue(steps: DataFrame, key: str = "trajectory_id", at: str = "thought_step") -> DataFrame:
    """Each step with the action before and after it."""
    w = Window.partitionBy(key).orderBy(at)
    return steps.withColumn("previous_action", F.lag("action").over(w)).withColumn("next_action", F.lead("action").over(w))


def import_review(queue: DataFrame, review: DataFrame) -> DataFrame:
    """Positives of a complete review; an unknown label or id, a repeated or a missing one is an error."""
    d = queue.select("item_id").join(review.groupBy("item_id").agg(F.count("*").alias("n"), F.first("label").alias("label")).withColumn("known", F.lit(True)), "item_id", "full_outer")
    d = d.join(queue.select("item_id", F.lit(True).alias("asked")), "item_id", "left")
    wrong = F.when(F.col("asked").isNull(), "unknown").when(F.col("known").isNull(), "missing").when(F.col("n") > 1, "repeated").when(~F.col("label").isin(*REVIEW_LABELS), "label")
    first = d.where(wrong.isNotNull()).select(F.concat(F.lit("review: "), wrong, F.lit(" "), F.col("item_id").cast("string")).alias("e")).agg(F.min("e").alias("e")).first()["e"]
    if first is not None:
        raise ValueError(first)
    return queue.join(review.where("label = 'direct_match'").select("item_id"), "item_id", "left_semi")


def leak_groups(rows: DataFrame) -> DataFrame:
    """group_id (the least trajectory) of each trajectory: trajectories that share a template, directly or by others, are one group.

    rows: trajectory_id, template. A null template is shared with nothing. Each trajectory goes to the least one of all its
    templates; only those are a graph, and mostly a small one.
    """
    known = rows.dropna(subset=["trajectory_id", "template"]).select("trajectory_id", F.col("template").cast("string").alias("template"))
    least = known.groupBy("template").agg(F.min("trajectory_id").alias("hub"))
    stars = written(skew.hot_join(known, least, ["template"], known.count()).select("trajectory_id", "hub").distinct(), "stars").hint("merge")
    total = stars.count()
    first = stars.groupBy("trajectory_id").agg(F.min("hub").alias("first"))
    labels = components(skew.hot_join(stars, first, ["trajectory_id"], total).select(F.col("hub").alias("a"), F.col("first").alias("b")))
    ends = first.select("first").distinct().join(labels.select(F.col("node").alias("first"), "label"), "first", "left").select("first", F.coalesce("label", "first").alias("group_id"))
    grouped = skew.hot_join(first, ends, ["first"], total).select("trajectory_id", "group_id")
    return rows.select("trajectory_id").distinct().join(grouped, "trajectory_id", "left").select("trajectory_id", F.coalesce("group_id", "trajectory_id").alias("group_id"))


#: Groups over 1 / LARGE of all rows are dealt one by one.
LARGE = 1000


def grouped_split(rows: DataFrame, seed: int = 7) -> DataFrame:
    """split of each group (group_id, rows, split); no group is in two splits.

    Groups over 1 / LARGE of all rows (fewer than LARGE) go one by one, large ones first, then in hashed order, to the split
    that lacks most rows; all others fill what the splits still lack, in hashed order, by the rows before them.
    """
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(F.lit(seed), "group_id"))
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    have = dict.fromkeys((n for n, _ in SPLITS), 0)
    target = {n: share * total for n, share in SPLITS}
    dealt = []
    for r in sizes.where(F.col("n") * LARGE > total).orderBy(F.desc("n"), "h", "group_id").collect():
        split = max(have, key=lambda s: target[s] - have[s])
        have[split] += r["n"]
        dealt.append((r["group_id"], r["n"], split))
    spark = rows.sparkSession
    first = spark.createDataFrame(dealt, StructType([sizes.schema["group_id"], StructField("rows", LongType()), StructField("split", StringType())]))
    small = sizes.where(F.col("n") * LARGE <= total).withColumn("b", F.shiftrightunsigned("h", 54))
    # place of a group without sorting all in one task: ranges of the hash first
    before = small.groupBy("b").agg(F.sum("n").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 1024 rows
    w = Window.partitionBy("b").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0))
    lacks = {s: max(target[s] - have[s], 0.0) for s in have}
    left = total - sum(have.values())
    scale = left / sum(lacks.values()) if sum(lacks.values()) else 0.0
    edge, split = 0.0, None
    for name in lacks:
        edge += lacks[name] * scale
        split = F.when(F.col("at") < edge, name) if split is None else split.when(F.col("at") < edge, name)
    placed = small.join(F.broadcast(before.select("b", "base")), "b").withColumn("at", at)
    rest = placed.select("group_id", F.col("n").alias("rows"), split.otherwise(SPLITS[-1][0]).alias("split"))
    return first.unionByName(rest)


#: A key of so many rows at most has its values put in order within a row.
SMALL = 128


def hard_negatives(positives: DataFrame, seed: int = 7, kept: int = 5) -> DataFrame:
    """Other actions for each intent, in its split: same tool and other target, other tool and same target, same trajectory.

    positives: item_id, split, trajectory_id, tool, target; a row with a null among these takes no part. An item has `kept`
    negatives, or all valid ones where there are fewer, and its kinds take turns. In a key's circular order by hash an item takes
    the valid ones of the next `kept` and the first `kept`, then items of the key's next other values (targets, tools, or both).
    A key of very many rows or values is put in order in parts of some BUCKET rows each (see skew.py); each part of its values
    alone has enough for its items.

    An item's row goes from kind to kind and takes its best `kept` along, so that candidates aren't shuffled as rows.
    """
    both = F.struct("tool", "target")
    kinds = {"same_trajectory": (["split", "trajectory_id"], both), "same_target": (["split", "target"], F.col("tool")), "same_tool": (["split", "tool"], F.col("target"))}
    names = sorted(kinds)
    known = written(positives.dropna(subset=["item_id", "split", "trajectory_id", "tool", "target"]).select("item_id", "split", "trajectory_id", "tool", "target"), "positives")
    total = known.count()
    d = known
    for name, (key, value) in kinds.items():
        large = written(known.groupBy(*key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > min(SMALL, skew.BUCKET)), "keys")
        hot = skew.hot_of(large, total)
        more = _of_other_values(known.select(*key, "item_id", value.alias("value")), key, large, hot, total, seed, kept) if large.limit(1).count() else None
        d = _near(d.withColumn("value", value), key, hot, seed, kept)
        if more is not None:
            d = d.where(~F.col("_lacks")).unionByName(skew.hot_join(d.where("_lacks").drop("more"), more, [*key, "value"], total))
        found = F.slice(F.array_distinct(F.concat("near", "more")), 1, kept)
        place = F.lit(names.index(name))
        told = F.transform(found, lambda x, k: F.struct((k * len(names) + place).cast("short").alias("codes"), x.alias("ids")))  # noqa: B023
        d = d.withColumn("best", told) if "codes" not in d.columns else _best(d.withColumn("best", F.concat(F.arrays_zip("codes", "ids"), told)), kept)
        if name != "same_tool":  # codes apart from ids: a row of less bytes
            d = d.select("item_id", "split", "tool", "target", F.col("best.codes").alias("codes"), F.col("best.ids").alias("ids"))
    d = d.select("item_id", "best")
    if known.groupBy("item_id").count().where("count > 1").limit(1).count():  # rows of one id are one item
        d = _best(d.groupBy("item_id").agg(F.flatten(F.collect_list("best")).alias("best")), kept, seed)
    d = d.select("item_id", F.posexplode("best").alias("place", "b"))
    return d.select("item_id", F.col("b.ids").alias("negative_id"), F.get(F.array(*map(F.lit, names)), F.col("b.codes") % len(names)).alias("kind"), (F.col("place") + 1).alias("rank"))


def _best(d: DataFrame, kept: int, seed: int | None = None) -> DataFrame:
    """d with the first `kept` different ids of `best` (codes, ids) by code; seed: those of one code by hash."""
    if seed is not None:
        d = d.withColumn("best", F.transform("best", lambda x: F.struct(x["codes"].alias("codes"), F.xxhash64(F.lit(seed), "item_id", x["ids"]).alias("h"), x["ids"].alias("ids"))))
    d = d.withColumn("best", F.sort_array("best"))
    first = F.filter("best", lambda x, k: ~F.exists(F.slice("best", F.lit(1), k), lambda y: y["ids"] == x["ids"]))
    d = d.withColumn("best", F.slice(F.when(F.size(F.array_distinct("best.ids")) == F.size("best"), F.col("best")).otherwise(first), 1, kept))
    return d if seed is None else d.withColumn("best", F.arrays_zip("best.codes", "best.ids"))


def _near(d: DataFrame, key: list[str], hot: DataFrame | None, seed: int, kept: int) -> DataFrame:
    """d (item_id, value) with `near`, the valid ids around each item, and `more`, those of its key's next other values where near ones are too few.

    `_lacks`: there are too few, and the key is too large for `more` to be found here.
    """
    d = skew.dealt(d, key, "item_id", hot)
    by_item = F.xxhash64(F.lit(seed), "item_id")
    part = Window.partitionBy(*key, "_part")
    d = d.withColumn("near", _circular(F.struct("item_id", "value"), part.orderBy(by_item, "item_id"), kept)).withColumn("_n", F.count("*").over(part))
    valid = F.transform(F.filter("near", lambda o: o["value"] != F.col("value")), lambda o: o["item_id"])
    d = d.withColumn("near", F.slice(F.array_distinct(valid), 1, kept))
    # of kept + 1 rows each is near to all others
    d = d.withColumn("_few", (F.size("near") < kept) & ((F.col("_n") > kept + 1) | (F.col("_parts") > 1)))
    small = (F.col("_n") <= min(SMALL, skew.BUCKET)) & (F.col("_parts") == 1)
    d = d.withColumn("_any", F.max("_few").over(part) & small)
    d = d.withColumn("_all", F.collect_list(F.when(F.col("_any"), F.struct(by_item.alias("h"), F.col("item_id"), F.col("value")))).over(part))
    d = d.withColumn("_all", F.sort_array(F.when(F.col("_few"), F.col("_all")).otherwise(F.slice("_all", 1, 0))))
    hashed = lambda v: F.struct(F.xxhash64(F.lit(seed), v).alias("h"), v.alias("value"))
    d = d.withColumn("_values", F.sort_array(F.array_distinct(F.transform("_all", lambda x: hashed(x["value"])))))
    d = d.withColumn("_at", F.array_position("_values", hashed(F.col("value"))).cast("int"))
    circle = F.concat(F.slice("_values", F.col("_at") + 1, F.lit(kept)), F.slice("_values", 1, kept))
    d = d.withColumn("_others", F.slice(F.array_distinct(F.filter(circle, lambda o: o["value"] != F.col("value"))), 1, kept))
    items = F.transform("_others", lambda o: F.transform(F.slice(F.filter("_all", lambda x: x["value"] == o["value"]), 1, kept), lambda x, k: F.struct(k.alias("r"), x["item_id"].alias("item_id"))))
    d = d.withColumn("more", F.transform(F.sort_array(F.flatten(items)), lambda x: x["item_id"]))
    return d.withColumn("_lacks", F.col("_few") & ~small).drop("_n", "_few", "_any", "_all", "_values", "_at", "_others", "_part", "_parts")


def _of_other_values(rows: DataFrame, key: list[str], large: DataFrame, hot: DataFrame | None, total: int, seed: int, kept: int) -> DataFrame | None:
    """`more`, ids of the key's next other values, of each key and value of which an item of a large key lacks near ones; None if none does."""
    lacking = written(_near(rows.join(large.select(*key), key, "left_semi"), key, hot, seed, kept).where("_lacks").select(*key, "value").distinct(), "lacking").hint("merge")  # many rows may be few bytes
    if not lacking.limit(1).count():
        return None
    first = Window.partitionBy(*key, "value").orderBy(F.xxhash64(F.lit(seed), "item_id"), "item_id")
    values = rows.join(lacking.select(*key).distinct(), key, "left_semi").withColumn("r", F.row_number().over(first)).where(F.col("r") <= kept).groupBy(*key, "value").agg(F.collect_list(F.struct("r", "item_id")).alias("items"))
    values = skew.with_part(values, key, "value", total)
    others = _circular(F.struct("value", "items"), Window.partitionBy(*key, "_part").orderBy(F.xxhash64(F.lit(seed), "value"), "value"), kept)
    values = values.withColumn("others", others).select(*key, "value", F.slice(F.array_distinct(F.filter("others", lambda o: o["value"] != F.col("value"))), 1, kept).alias("others"))
    values = values.select(*key, "value", F.transform(F.array_sort(F.flatten(F.transform("others", lambda o: o["items"]))), lambda x: x["item_id"]).alias("more"))
    return written(values.join(lacking, [*key, "value"], "left_semi"), "more").hint("merge")


def _circular(row: Column, w, n: int) -> Column:
    """The n rows after each in its partition, then the partition's first n."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = [F.lead(row, k).over(w) for k in range(1, n + 1)] + [F.nth_value(row, k).over(whole) for k in range(1, n + 1)]
    return F.filter(F.array(*rows), lambda o: o.isNotNull())


#: Candidates of one positive, before judgement.
PROPOSED = 12
NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def parameter_corruptions(positives: DataFrame, seed: int = 7, most: int = PROPOSED) -> DataFrame:
    """Actions that differ from a positive in one argument: item_id, field, value, arguments, observed_id (null: reconstructed) and rank.

    positives: item_id, split, intent, tool and arguments (map of texts); a row with a null among these takes no part. A field's
    new value is one that another action of the split gives to the same field of the same tool, of the same type (number or
    text). Each positive has `most` candidates, or all where there are fewer: those that some action of the split is, first, each
    with the least id of such an action; then by a seeded hash. Of each field the next `most` values of a circular order by hash
    are tried. What is a positive of the same intent is no candidate; equal candidates are one.

    A pool's values are put in order as values, not as rows; pools and values of very many rows are dealt out (see skew.py).
    What an action may become is found once for equal actions, as a list in order; a positive takes the first of it that its
    intent lacks. So candidates are shuffled as rows only for intents of many different actions, and for repeated ids.
    """
    same = lambda tool, a: F.unhex(F.sha2(F.to_json(F.struct(tool.alias("tool"), a.alias("arguments"))), 256))
    known = positives.dropna(subset=["item_id", "split", "intent", "tool", "arguments"]).select("item_id", "split", "intent", "tool", F.map_from_entries(F.array_sort(F.map_entries("arguments"))).alias("arguments"))
    known = written(known.withColumn("action", same(F.col("tool"), F.col("arguments"))), "positives")
    total = known.count()
    order = lambda c: F.sha2(F.concat(F.lit(f"{seed}:"), c), 256)
    unlike = lambda: (F.col("observed_id").isNull().alias("unseen"), order(F.concat_ws(":", "field", "value")).alias("h"), F.col("field"), F.col("value"))
    lists = _lists_of_others(known, total, same, order, unlike, most)
    told = F.transform("others", lambda x: F.octet_length(x["value"]) + F.octet_length(x["field"]) + ROW_BYTES)
    few = (lists.agg(F.sum(F.aggregate(told, F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0) <= LIST_BYTES
    put = lambda d: d.join(F.broadcast(lists), ["split", "action"]) if few else skew.hot_join(d, lists, ["split", "action"], total)
    group = ["split", "intent", "tool"]
    listed, apart = None, known
    if not known.groupBy("item_id").count().where("count > 1").limit(1).count():
        hot = skew.hot_keys(known, group, total)
        cold = known if hot is None else known.join(hot, group, "left_anti")
        taken = written(cold.groupBy(*group).agg(F.collect_set("action").alias("taken")).where("size(taken) > 1"), "taken").hint("merge")
        listed = cold.join(taken, group, "left")
        apart = None if hot is None else known.join(hot, group, "left_semi")
        if taken.where(F.size("taken") > TAKEN).limit(1).count():
            many = listed.where(F.size("taken") > TAKEN).drop("taken")
            apart = many.select(*known.columns) if apart is None else apart.unionByName(many)
            listed = listed.where(F.col("taken").isNull() | (F.size("taken") <= TAKEN))
    changed = F.map_from_entries(F.transform(F.map_entries("arguments"), lambda e: F.when(e["key"] == F.col("field"), F.struct(e["key"].alias("key"), F.col("value").alias("value"))).otherwise(e)))
    out = []
    if listed is not None:
        free = F.filter("others", lambda x: ~F.coalesce(F.array_contains("taken", x["action"]), F.lit(False)))
        d = put(listed).select("item_id", "arguments", F.posexplode(F.slice(F.when(F.col("taken").isNull(), F.col("others")).otherwise(free), 1, most)).alias("place", "x"))
        out.append(d.select("item_id", "x.field", "x.value", "arguments", "x.observed_id", (F.col("place") + 1).alias("rank")))
    if apart is not None:
        d = put(apart).select("item_id", "split", "intent", "arguments", F.explode("others").alias("x")).select("item_id", "split", "intent", "arguments", "x.*")
        d = d.join(known.select("split", "intent", "action").distinct(), ["split", "intent", "action"], "left_anti")
        d = d.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*unlike()))).where(F.col("rank") <= most)
        out.append(d.select("item_id", "field", "value", "arguments", "observed_id", "rank"))
    return reduce(DataFrame.unionByName, out).select("item_id", "field", "value", changed.alias("arguments"), "observed_id", "rank")


#: An intent of more different actions of a tool has them joined as rows.
TAKEN = 32
#: Lists of all actions are broadcast up to so many bytes, by their texts and ROW_BYTES for each entry.
LIST_BYTES = 32 << 20
ROW_BYTES = 128


def _lists_of_others(known: DataFrame, total: int, same, order, unlike, most: int) -> DataFrame:
    """`others` of each different action of a split, in order: field, value, observed_id, and the action where it is observed."""
    actions = written(known.groupBy("split", "action").agg(F.min("item_id").alias("observed_id"), F.first("tool").alias("tool"), F.first("arguments").alias("arguments")), "actions").hint("merge")
    pool = ["split", "tool", "field", "number"]
    each = actions.select("split", "action", "tool", "arguments", F.explode("arguments").alias("field", "value")).where("value is not null").withColumn("number", F.col("value").rlike(NUMBER))
    values = skew.with_part(each.select(*pool, "value").distinct(), pool, "value", total)
    w = Window.partitionBy(*pool, "_part").orderBy(order(F.col("value")), "value")
    others = F.slice(F.array_distinct(F.filter(_circular(F.col("value"), w, most), lambda o: o != F.col("value"))), 1, most)
    values = values.select(*pool, "value", others.alias("others"))
    tried = skew.hot_join(each, values, [*pool, "value"], total).select("split", F.col("action").alias("of"), "tool", "arguments", "field", F.explode("others").alias("value"))
    changed = F.map_from_entries(F.transform(F.map_entries("arguments"), lambda e: F.when(e["key"] == F.col("field"), F.struct(e["key"].alias("key"), F.col("value").alias("value"))).otherwise(e)))
    tried = tried.select("split", "of", "field", "value", same(F.col("tool"), changed).alias("action")).join(actions.select("split", "action", "observed_id"), ["split", "action"], "left")
    entry = F.struct(*unlike(), "observed_id", F.when(F.col("observed_id").isNotNull(), F.col("action")).alias("action"))
    lists = tried.groupBy("split", F.col("of").alias("action")).agg(F.sort_array(F.collect_list(entry)).alias("others"))
    return written(lists.withColumn("others", F.transform("others", lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"), x["observed_id"].alias("observed_id"), x["action"].alias("action")))), "lists").hint("merge")


def accepted(judged: DataFrame, positives: DataFrame) -> DataFrame:
    """Judged negatives that are safe, sure, unflagged, unique and no known positive."""
    safe = judged.where((F.col("verdict") == "safe_negative") & (F.col("confidence") >= 0.90) & (F.size("flags") == 0)).dropDuplicates(["item_id", "negative_id"])
    return safe.join(positives.select("item_id", F.col("action_item").alias("negative_id")), ["item_id", "negative_id"], "left_anti")


# --- canonical actions ------------------------------------------------------------------------------------------------

#: The named fields of the commands that have a form of their own; a field in capitals takes the rest of the line.
FIELDS = {"search_dir": ("query", "path"), "open": ("path",), "goto": ("line",), "scroll_down": (), "python": ("COMMAND",), "rm": ("path",), "create": ("path",)}


def canonical(action: str | None) -> str | None:
    """`[ACTION] name(field="value", ...)`; commands without named fields keep their arguments as one text; null if it can't be parsed."""
    try:
        words = shlex.split(action or "")
    except ValueError:
        return None
    if not words:
        return None
    name, args = words[0], words[1:]
    rest = (action or "").strip()[len(name) :].strip()
    fields = FIELDS.get(name)
    quoted = lambda v: json.dumps(v, ensure_ascii=False)
    if fields and fields[0].isupper() and args:
        told = [f"{fields[0].lower()}={quoted(rest)}"]
    elif fields is not None and 0 < len(args) <= len(fields) and not fields[0].isupper() or fields == () and not args:
        told = [f"{k}={v if k == 'line' and v.isdecimal() else quoted(v)}" for k, v in zip(fields, args, strict=False)]
    else:
        told = [f"args={quoted(rest)}"]
    return f"[ACTION] {name}({', '.join(told)})"


@F.pandas_udf(StringType())
def canonical_action(actions: pd.Series) -> pd.Series:
    return actions.map(canonical)


def candidate_audit(steps: DataFrame) -> DataFrame:
    """Of each source: trajectories, steps, and how they split into candidates, steps with too long an action, unfulfilled and other ones.

    steps: source, trajectory_id, status, intents, actions (texts). The parts add up to the steps (`consistent`).
    """
    only = F.get("actions", F.lit(0))
    one = (F.col("status") == "success") & (F.size("intents") == 1)
    short = F.size(short_action_reasons(T.text_or_empty(only), T.text_or_empty(only))) == 0
    kind = F.when(F.coalesce(one & (F.size("actions") == 1), F.lit(False)), F.when(short, "candidate").otherwise("long")).when(F.coalesce(one & (F.size("actions") == 0), F.lit(False)), "unfulfilled").otherwise("other")
    d = steps.withColumn("_kind", kind)
    parts = [F.count_if(F.col("_kind") == k).alias(k) for k in ("candidate", "long", "unfulfilled", "other")]
    out = d.groupBy("source").agg(F.count_distinct("trajectory_id").alias("trajectories"), F.count("*").alias("steps"), *parts)
    return out.withColumn("consistent", F.col("candidate") + F.col("long") + F.col("unfulfilled") + F.col("other") == F.col("steps"))


# --- judgement --------------------------------------------------------------------------------------------------------

#: Fixed values.
VERDICTS = ("safe_negative", "semantic_match", "partial_or_supporting", "ambiguous", "invalid_candidate")
VERDICT_FIELDS = ("confidence", "label", "negative_type", "reason", "risk_flags")


def verdict_status(raw: Column) -> Column:
    """Status of a judge's answer: invalid_json, invalid_schema (other fields, or of other types), invalid_label, invalid_confidence or valid."""
    v = F.try_parse_json(raw)
    shape = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    keys = F.array_join(F.array_sort(F.json_object_keys(F.to_json(v))), ",")
    number = shape("$.confidence").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    typed = number & (shape("$.label") == "STRING") & (shape("$.negative_type") == "STRING") & (shape("$.reason") == "STRING") & shape("$.risk_flags").startswith("ARRAY")
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT") & (keys == ",".join(VERDICT_FIELDS)) & typed, F.lit(False))
    return (
        F.when(v.isNull(), "invalid_json").when(~good, "invalid_schema").when(~F.try_variant_get(v, "$.label", "string").isin(*VERDICTS), "invalid_label")
        .when(~F.try_variant_get(v, "$.confidence", "double").between(0.0, 1.0), "invalid_confidence").otherwise("valid")
    )


def candidate_id(*parts: Column) -> Column:
    """A stable name for a candidate: a digest of the dataset's version, split, intent, kind, action and generator."""
    return F.sha2(F.to_json(F.array(*(c.cast("string") for c in parts))), 256)


def judgement_key(candidate: Column, prompt_hash: str, model: str, settings_hash: str) -> Column:
    """A judgement counts only for the same candidate, prompt, model and settings."""
    return F.sha2(F.concat_ws("\n", candidate, F.lit(prompt_hash), F.lit(model), F.lit(settings_hash)), 256)


def unjudged(candidates: DataFrame, judgements: DataFrame) -> DataFrame:
    """Candidates (with `key`) without a successful judgement of their key."""
    return candidates.join(judgements.where("status = 'success'").select("key"), "key", "left_anti")
