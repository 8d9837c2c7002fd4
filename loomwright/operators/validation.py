"""Constraints, as a status for model output and as an error for corrupt input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators.alignment import SCOPES

#: The counts that a selection of 500 must have.
FROZEN_500 = {
    "target_counts": {"true": 250, "false": 250}, "model_counts": {"swe-agent-llama-70b": 350, "swe-agent-llama-8b": 100, "swe-agent-llama-405b": 50},
    "selection_group_counts": {"paired": 250, "diversity": 250},
}
_QUOTED = "struct<intents:array<struct<intent_quote:string,temporal_scope:string>>>"


def extraction_status(raw: Column, thought: Column) -> Column:
    """Status of a compact extraction: the first rule broken, intent by intent, source order last."""
    v = F.try_parse_json(raw)
    shape = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$.intents", "array<variant>")
    keys = lambda x: F.array_sort(F.json_object_keys(F.to_json(x)))
    top = F.coalesce(shape.startswith("OBJECT") & (F.array_join(keys(v), ",") == "intents") & items.isNotNull(), F.lit(False))
    read = F.transform(items, lambda i: F.struct(
        F.coalesce(F.schema_of_variant(i).startswith("OBJECT") & (F.array_join(keys(i), ",") == "intent_quote,temporal_scope"), F.lit(False)).alias("ok"),
        F.when(F.schema_of_variant(F.try_variant_get(i, "$.intent_quote", "variant")) == "STRING", F.try_variant_get(i, "$.intent_quote", "string")).alias("q"),
        F.when(F.schema_of_variant(F.try_variant_get(i, "$.temporal_scope", "variant")) == "STRING", F.try_variant_get(i, "$.temporal_scope", "string")).alias("s"),
    ))

    def rule(x, k):
        earlier = F.slice(read, F.lit(1), k)
        return (
            F.when(~x["ok"], "invalid_schema")
            .when(x["q"].isNull() | (T.strip(x["q"]) == "") | ~F.coalesce(x["s"].isin(*SCOPES), F.lit(False)), "invalid_scope_or_quote")
            .when(~F.contains(thought, x["q"]), "non_source_quote")
            .when(F.exists(earlier, lambda e: e["q"] == x["q"]), "duplicate_quote")
        )

    broken = F.get(F.filter(F.transform(read, rule), lambda r: r.isNotNull()), F.lit(0))
    places = F.transform(read, lambda x: F.instr(thought, x["q"]))
    return F.when(v.isNull(), "invalid_json").when(~top, "invalid_schema").when(broken.isNotNull(), broken).when(places != F.array_sort(places), "source_order_wrong").otherwise("valid")


def intent_status(result: Column, step: Column, thought: Column) -> Column:
    """Status of an intent result (struct as SURVEYed: thought_step, execution_intents, no_intent_reason): null if valid, else the first rule broken."""
    items = result["execution_intents"]

    def rule(x, k):
        want = F.concat(F.lit("T"), step.cast("string"), F.lit("-I"), (k + 1).cast("string"))
        blank = lambda c: T.strip(T.text_or_empty(c)) == ""
        return F.when(~F.coalesce(x["intent_id"] == want, F.lit(False)), "intent_id").when(blank(x["intent_text"]), "blank_text").when(blank(x["source_quote"]), "blank_quote").when(~F.contains(thought, x["source_quote"]), "quote_not_in_source")

    broken = F.get(F.filter(F.transform(items, rule), lambda r: r.isNotNull()), F.lit(0))
    empty = F.size(items) == 0
    reason = T.strip(T.text_or_empty(result["no_intent_reason"])) != ""
    return (
        F.when(~F.coalesce(result["thought_step"] == step, F.lit(False)), "thought_step").when(items.isNull(), "intents").when(broken.isNotNull(), broken)
        .when(empty & ~reason, "reason_missing").when(~empty & result["no_intent_reason"].isNotNull(), "reason_with_intents")
    )


def duplicates(d: DataFrame, key: str) -> DataFrame:
    return d.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(d: DataFrame, key: str) -> DataFrame:
    """d, or an error that names the smallest repeated key."""
    worst = duplicates(d, key).agg(F.min(key).alias("k")).first()["k"]
    if worst is not None:
        raise ValueError(f"repeated {key}: {worst}")
    return d


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only."""
    only = lambda a, b, name: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit(name))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def snapshot_rules(cases: DataFrame, listed: DataFrame, manifest: DataFrame, summary: Mapping[str, object] | None, expected: int, frozen: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """(position, rule, ok, detail) of a snapshot, in the order in which a fail-fast check would meet them.

    cases: file_name, case_id, target, model_name, selection_group. listed: case_id of the JSON lines. manifest: selection_id.
    summary: selected_count, and target_counts, model_counts and selection_group_counts by label. frozen: such counts that must hold (those of FROZEN_500 where 500 are expected).
    """
    frozen = FROZEN_500 if frozen is None and expected == 500 else frozen
    spark = cases.sparkSession
    tagged = [d.select(T.text_or_empty(F.col(c)).alias("id"), F.lit(k).alias("k")) for k, (d, c) in enumerate(((cases, "case_id"), (listed, "case_id"), (manifest, "selection_id")))]
    by = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("id").agg(*(F.count_if(F.col("k") == k).alias(f"n{k}") for k in range(3)))
    worst = lambda when: F.min(F.when(when, F.col("id")))
    ids = by.agg(
        *(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(3)), *(worst(F.col(f"n{k}") > 1).alias(f"twice{k}") for k in range(3)),
        *(worst((F.col("n0") > 0) != (F.col(f"n{k}") > 0)).alias(f"differ{k}") for k in (1, 2)),
    ).first()
    bad = ~F.col("file_name").rlike(r"^CASE-\d{4}\.json$")
    stem = F.regexp_replace("file_name", r"\.json$", "")
    names = cases.agg(F.min(F.when(bad, F.col("file_name"))).alias("bad"), F.min(F.when(T.text_or_empty(F.col("case_id")) != stem, F.col("file_name"))).alias("stem")).first()
    kinds = {"target_counts": F.lower(F.col("target").cast("string")), "model_counts": F.col("model_name").cast("string"), "selection_group_counts": F.col("selection_group").cast("string")}
    flat = cases.select(F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.coalesce(c, F.lit("none")).alias("label")) for k, c in kinds.items()))).alias("x"))
    derived: dict[str, dict[str, int]] = {k: {} for k in kinds}
    for r in flat.groupBy("x.field", "x.label").count().collect():  # as many as there are labels
        derived[r["field"]][r["label"]] = r["count"]
    said = summary or {}
    rules = [
        ("the expected count is positive", expected > 0, str(expected)),
        ("number of files", ids["n0"] == expected, str(ids["n0"])),
        ("file names", names["bad"] is None, names["bad"]),
        ("unique case ids", ids["twice0"] is None, ids["twice0"]),
        ("case ids equal file names", names["stem"] is None, names["stem"]),
        ("unique ids of JSON lines", ids["twice1"] is None, ids["twice1"]),
        ("ids of JSON lines", ids["n1"] == expected and ids["differ1"] is None, ids["differ1"]),
        ("unique ids of the manifest", ids["twice2"] is None, ids["twice2"]),
        ("ids of the manifest", ids["n2"] == expected and ids["differ2"] is None, ids["differ2"]),
        ("there is a summary", summary is not None, None),
        ("selected_count", said.get("selected_count") == expected, str(said.get("selected_count"))),
        *((f"{k} as derived", said.get(k) == derived[k], str(derived[k])) for k in kinds),
        *((f"{k} as frozen", said.get(k) == dict(v), str(dict(v))) for k, v in (frozen or {}).items()),
    ]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "position int, rule string, ok boolean, detail string")


def require_snapshot(rules: DataFrame) -> None:
    """An error that names the first broken rule."""
    broken = rules.where("not ok").orderBy("position").limit(1).collect()
    if broken:
        raise ValueError(f"snapshot: {broken[0]['rule']}: {broken[0]['detail']}")


def require_samples(asked: Sequence[str], known: DataFrame, key: str = "case_id") -> list[str]:
    """The sample ids asked for, or an error if one repeats or (the smallest is named) is unknown."""
    if len(set(asked)) < len(asked):
        raise ValueError("sample ids repeat")
    d = known.sparkSession.createDataFrame([(a,) for a in asked], f"{key} string")
    missing = d.join(known.select(F.col(key).cast("string").alias(key)), key, "left_anti").agg(F.min(key).alias("k")).first()["k"]
    if missing is not None:
        raise ValueError(f"no such sample: {missing}")
    return list(asked)
