"""Operator inputs made from the star-schema tables, the same for every engine.

A user's events become one trajectory: each event is an agent's message (a
thought, then a fenced command) and the user's answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMANDS = {"view": "open src/main.py", "click": "edit 3:4", "error": "pytest tests", "signup": "python run.py", "purchase": "submit"}
MODELS = ("70b", "8b", "405b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ts, event_id, thought, command, reply."""
    e = table(spark, sf_dir, "events")
    command = F.lit(None).cast("string")
    for kind, line in COMMANDS.items():
        command = F.when(F.col("event_type") == kind, line).otherwise(command)
    number = F.col("event_id").cast("string")
    thought = F.when(F.col("event_id") % 17 == 0, "Done.").otherwise(F.concat(F.lit("We should check item "), number, F.lit(" because the result looks odd.")))
    reply = F.when(F.col("event_id") % 19 == 0, "  ").otherwise(F.concat(F.lit("value "), number))
    return e.select("user_id", "ts", "event_id", "event_type", thought.alias("thought"), command.alias("command"), reply.alias("reply"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each user of events."""
    s = event_steps(spark, sf_dir)
    says = F.concat("thought", F.lit("\n```\n"), "command", F.lit("\n```"))
    steps = s.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", says.alias("ai"), "reply"))).alias("s"))
    u = F.col("user_id")
    message = lambda role, text, prompt="": F.struct(F.lit(role).alias("role"), text.alias("text"), F.lit(prompt).alias("system_prompt"))
    issue = F.when(u % 5 == 0, "Add a flag\nwrong value").otherwise("ISSUE:\n# Crash when value is wrong\nmore")
    model = F.element_at(F.array(*map(F.lit, MODELS)), (u % 3 + 1).cast("int"))
    turns = F.flatten(F.transform("s", lambda x: F.array(message("ai", x["ai"]), message("user", x["reply"]))))
    return steps.select(
        "user_id",
        F.concat(F.lit("owner__repo"), (u % 7).cast("string"), F.lit("-"), u.cast("string")).alias("instance_id"),
        F.concat(F.lit("swe-agent-llama-"), model).alias("model_name"),
        (u % 2 == 0).alias("target"),
        F.lit("submitted").alias("exit_status"),
        F.when(u % 13 == 0, "").otherwise("diff --git a/x b/x\n@@ -1 +1 @@ a changed line to fix it").alias("generated_patch"),
        F.when(u % 17 == 0, "short").otherwise(F.repeat(F.lit("log line "), (u % 100 * 2 + 20).cast("int"))).alias("eval_logs"),
        F.concat(F.array(message("system", F.lit(""), "Be brief."), message("user", issue)), turns).alias("trajectory"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates from finished orders: instance = customer, outcome = status, model = priority."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    return o.select(
        F.col("o_orderkey").cast("string").alias("uid"),
        F.col("o_custkey").cast("string").alias("instance_id"),
        F.concat(F.lit("r"), (F.col("o_custkey") % 50).cast("string")).alias("repository"),
        F.lower(F.substring_index("o_orderpriority", "-", 1)).alias("model_short"),
        (F.col("o_orderstatus") == "F").alias("target"),
        F.col("o_totalprice").alias("quality_score"),
        F.when(F.col("o_totalprice") < 100000, "10-19").when(F.col("o_totalprice") < 200000, "20-39").otherwise("40+").alias("length_band"),
    )


def line_actions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """intents, pairs and units from order lines: line = action, supplier number mod 3 = intent, return flag = match."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_suppkey").alias("s"))
    match = F.when(F.col("f") == "A", "yes").when(F.col("f") == "R", "no").otherwise("uncertain")
    base = lines.select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").cast("string").alias("action_id"), (F.col("s") % 3).cast("string").alias("intent_id"), match.alias("operation_match"))
    intents = base.select("unit_id", "intent_id", F.when(F.col("intent_id") == "2", "future").otherwise("current").alias("temporal_scope")).distinct()
    units = base.groupBy("unit_id").agg(F.count("*").alias("n_actions")).withColumn("window_complete", F.col("unit_id") % 4 != 0)
    return intents, base, units
