"""From raw trajectories to cycles, features, the hard filter and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T

MODEL_PREFIX = "swe-agent-"


def cycles(messages: Column) -> Column:
    """Valid cycles: an agent's message with an explicit thought and a fenced action, then a user's answer."""
    at = F.sequence(F.lit(0), F.size(messages) - 1)

    def cycle(i):
        m, after = F.get(messages, i), F.get(messages, i + 1)
        answered = (m["role"] == "ai") & (after["role"] == "user") & (T.strip(T.text_or_empty(after["text"])) != "")
        found = T.bound(T.last_block(m["text"]), lambda b: F.when((b["action"] != "") & T.is_explicit_thought(b["thought"]), F.struct(b["thought"].alias("thought"), b["action"].alias("action"), T.strip(after["text"]).alias("observation"))))
        return F.when(answered, found)

    return F.when(F.size(messages) > 0, F.filter(F.transform(at, cycle), lambda c: c.isNotNull())).otherwise(F.array())


def _once(d: DataFrame, **columns: Column) -> DataFrame:
    """d with columns that are computed once a row: what reads them is not merged with them, as it is with a projection."""
    return d.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def context_complete(messages: Column, issue: Column) -> Column:
    """A first message of the system with a prompt or text, and an issue."""
    first = F.get(messages, F.lit(0))
    prompt = T.strip(T.text_or_empty(F.coalesce(F.nullif(first["system_prompt"], F.lit("")), first["text"])))
    return F.coalesce((first["role"] == "system") & (prompt != "") & (issue != ""), F.lit(False))


def features(records: DataFrame) -> DataFrame:
    """Everything the filter and the score need, beside the record."""
    patch, log = T.strip(T.text_or_empty(F.col("generated_patch"))), T.strip(T.text_or_empty(F.col("eval_logs")))
    d = _once(records, cycles=cycles(F.col("trajectory")), issue=T.issue_text(F.col("trajectory")))
    d = _once(
        d,
        ai_turns=F.size(F.filter("trajectory", lambda m: m["role"] == "ai")),
        valid_cycles=F.size("cycles"),
        phases=F.array_sort(F.array_distinct(F.transform("cycles", lambda c: T.action_phase(c["action"])))),
        thought_chars=F.aggregate("cycles", F.lit(0).cast("long"), lambda a, c: a + F.length(c["thought"])),
        title=T.issue_title(F.col("issue")),
        context_complete=context_complete(F.col("trajectory"), F.col("issue")),
        patch_evidence=(F.length(patch) >= 40) & (patch.contains("diff --git") | patch.contains("@@")),
        eval_evidence=F.length(log) >= 100,
        log_chars=F.length(T.text_or_empty(F.col("eval_logs"))),
        repository=T.repository(F.col("instance_id")),
        model_short=T.model_short(F.col("model_name")),
    )
    ratio = F.when(F.col("ai_turns") > 0, F.col("valid_cycles") / F.col("ai_turns")).otherwise(0.0)
    mean = F.when(F.col("valid_cycles") > 0, F.col("thought_chars") / F.col("valid_cycles")).otherwise(0.0)
    return d.withColumn("ratio", ratio).withColumn("mean_chars", mean).withColumn("length_band", T.length_band(F.col("valid_cycles")))


def hard_filter_terms() -> dict[str, Column]:
    """The filter's conjuncts over features(), the cheap ones first."""
    c = F.col
    return {
        "model": c("model_name").startswith(MODEL_PREFIX),
        "target": c("target").isNotNull(),
        "turns": (c("ai_turns") >= 10) & (c("valid_cycles") >= 10),
        "ratio": c("ratio") >= 0.8,
        "phases": F.array_contains("phases", "inspect") & F.array_contains("phases", "edit"),
        "patch": c("patch_evidence"),
        "log": c("eval_evidence"),
        "context": c("context_complete"),
        "bugfix": T.is_bugfix(c("title")),
    }


def eligible(d: DataFrame) -> DataFrame:
    for term in hard_filter_terms().values():
        d = d.where(term)
    return d


def scored(d: DataFrame, rounded: bool = True) -> DataFrame:
    """quality_score; rounded: ratio, mean and score to decimals, by their exact binary values, half to even."""
    r, m = (T.round_exact(F.col("ratio"), 6), T.round_exact(F.col("mean_chars"), 2)) if rounded else (F.col("ratio"), F.col("mean_chars"))
    s = T.quality_score(F.col("valid_cycles"), r, m, F.col("phases"), F.col("patch_evidence"), F.col("eval_evidence"), F.col("log_chars"))
    return d.withColumn("quality_score", T.round_exact(s, 3) if rounded else s)


def cases(records: DataFrame) -> DataFrame:
    """Records (with selection_id, selection_group and pair_id) as cases with numbered steps."""
    first = lambda role, field: F.coalesce(F.get(F.filter(F.transform("trajectory", lambda m: F.when(m["role"] == role, T.strip(T.text_or_empty(m[field])))), lambda x: x != ""), F.lit(0)), F.lit(""))
    steps = F.transform("_cycles", lambda c, i: F.struct((i + 1).cast("long").alias("step"), c["thought"].alias("thought"), c["action"].alias("action"), c["observation"].alias("observation")))
    records = _once(records, _cycles=cycles(F.col("trajectory")))
    return records.select(
        F.col("selection_id").alias("case_id"), "selection_group", "pair_id", "instance_id", T.repository(F.col("instance_id")).alias("repository"), "model_name", "target", "exit_status",
        first("system", "system_prompt").alias("system_prompt"), first("user", "text").alias("task"), steps.alias("steps"), "generated_patch", "eval_logs",
    )
