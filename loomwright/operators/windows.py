"""Windows of agent calls: a strict reader that names the first broken rule, and the text that a model sees of each call.

A window is a JSON object with `unit_id`, `thought`, `window_complete` and `actions`; a call comes in four shapes (`tool` or
`function`, `arguments` or `args`, within `raw_call` or not, the name and arguments within one object or not; arguments may be
JSON text). A key that is there counts, whatever its value, before the key that stands in for it. Checks are made on VARIANT
values in the JVM, so a window is parsed once; the calls' own texts keep the order of their keys, which VARIANT doesn't.

Defined results: null and empty texts, and JSON objects with a repeated key, are no objects; an id that is no string is its text
(`True`, `None` and numbers as Python tells them, other values as JSON); ids count from A1 where a call has none; a window
without calls is valid; other keys are ignored; each row is judged for itself.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loomwright.functions import text as T

# --- fixed values ---
#: The rules in the order in which they are checked.
WINDOW_FAULTS = ("no_object", "thought_is_no_text", "unit_id_is_blank", "actions_are_no_list", "window_complete_is_no_flag")
ACTION_FAULTS = ("action_is_no_object", "call_is_no_object", "arguments_are_no_json", "tool_is_blank", "arguments_are_no_object", "action_id_is_empty", "action_id_repeats")
TARGET_KEYS = ("path", "file", "url", "uri", "target", "command", "cmd", "method")

CALLS = "array<struct<action_id:string,tool:string,arguments:string>>"


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column) -> Column:
    """A scalar as text; null for other values."""
    return _get(v, "$", "string")


def _shape(a: Column) -> Column:
    """tool and arguments of a call as VARIANT, arguments parsed where they are text, and the fault that stops the reader."""
    call = F.coalesce(_get(a, "$.raw_call"), a)
    named = F.coalesce(_get(call, "$.tool"), _get(call, "$.function"))
    nested = _is(named, "OBJECT")
    tool = F.when(nested, _get(named, "$.name")).otherwise(named)
    given = F.when(nested, _get(named, "$.arguments")).otherwise(F.coalesce(_get(call, "$.arguments"), _get(call, "$.args")))
    quoted = _is(given, "STRING")
    arguments = F.when(quoted, F.try_parse_json(_text(given))).otherwise(given)
    fault = (
        F.when(~_is(a, "OBJECT"), ACTION_FAULTS[0]).when(~_is(call, "OBJECT"), ACTION_FAULTS[1]).when(quoted & arguments.isNull(), ACTION_FAULTS[2])
        .when(~_is(tool, "STRING") | (T.strip(F.coalesce(_text(tool), F.lit(""))) == ""), ACTION_FAULTS[3]).when(~_is(arguments, "OBJECT"), ACTION_FAULTS[4])
    )
    return F.struct(fault.alias("fault"), _text(tool).alias("tool"), F.coalesce(_get(a, "$.action_id"), _get(a, "$.id"), _get(call, "$.id")).alias("id"))


def _id(v: Column, k: Column) -> Column:
    kind = F.schema_of_variant(v)
    told = F.when(kind == "BOOLEAN", F.initcap(_text(v))).when(kind == "VOID", "None").when(_text(v).isNull(), F.to_json(v)).otherwise(_text(v))
    return F.when(v.isNull(), F.concat(F.lit("A"), (k + 1).cast("string"))).otherwise(told)


def _arguments(a: Column) -> Column:
    """The text of a call's arguments as it was written; a: the call's own text."""
    within = F.get_json_object(a, "$.raw_call")
    call = F.when(F.get(F.json_object_keys(a), F.lit(0)).isNotNull() & F.array_contains(F.json_object_keys(a), "raw_call"), within).otherwise(a)
    keys = F.json_object_keys(call)
    named = F.when(F.array_contains(keys, "tool"), F.get_json_object(call, "$.tool")).otherwise(F.get_json_object(call, "$.function"))
    nested = F.coalesce(F.schema_of_variant(F.try_parse_json(named)).startswith("OBJECT"), F.lit(False))
    own = F.when(F.array_contains(keys, "arguments"), F.get_json_object(call, "$.arguments")).otherwise(F.get_json_object(call, "$.args"))
    return F.when(nested, F.get_json_object(named, "$.arguments")).otherwise(own)


def checked_windows(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with unit_id, thought, window_complete, status (`valid` or the first broken rule), fault_at (the call's number) and calls.

    calls: action_id, tool and the arguments' text, in order; null unless the window is valid.
    """
    # a parser stops at the end of a first value; what follows it shows within a list with a mark at its end
    whole = F.try_parse_json(F.concat(F.lit("["), F.col(value), F.lit("\n,7]")))
    v = lines.withColumn("_whole", whole).withColumn("_v", F.when(_get(F.col("_whole"), "$[1]", "int").eqNullSafe(7) & _get(F.col("_whole"), "$[2]").isNull(), _get(F.col("_whole"), "$[0]")))
    v = v.withColumn("_actions", F.try_variant_get("_v", "$.actions", "array<variant>"))
    v = v.withColumn("_calls", F.transform("_actions", _shape)).withColumn("_ids", F.transform("_calls", lambda c, k: _id(c["id"], k)))
    # the second of two equal ids that comes first, by sorting, so that long windows cost no pairs
    placed = F.array_sort(F.transform("_ids", lambda x, k: F.struct(x.alias("id"), k.alias("k"))))
    again = F.zip_with(placed, F.slice(placed, 2, F.greatest(F.size(placed), F.lit(1))), lambda p, q: F.when(p["id"] == q["id"], q["k"]))
    first = lambda faults: F.array_min(F.transform(faults, lambda f, k: F.when(f.isNotNull(), F.struct(k.alias("k"), f.alias("fault")))))
    v = v.withColumn("_repeat", F.array_min(again)).withColumn("_broken", first(F.transform("_calls", lambda c: c["fault"])))
    v = v.withColumn("_empty", first(F.transform("_ids", lambda x: F.when(x == "", ACTION_FAULTS[5]))))
    # of faults of one call its shape comes first, then an empty id, then a repeated one
    ranked = F.array(
        F.when(F.col("_broken").isNotNull(), F.struct(F.col("_broken.k").alias("k"), F.lit(0).alias("r"), F.col("_broken.fault").alias("fault"))),
        F.when(F.col("_empty").isNotNull(), F.struct(F.col("_empty.k").alias("k"), F.lit(1).alias("r"), F.col("_empty.fault").alias("fault"))),
        F.when(F.col("_repeat").isNotNull(), F.struct(F.col("_repeat").alias("k"), F.lit(2).alias("r"), F.lit(ACTION_FAULTS[6]).alias("fault"))),
    )
    v = v.withColumn("_fault", F.array_min(ranked))
    field = lambda name: _get(F.col("_v"), f"$.{name}")
    window = (
        F.when(~_is(F.col("_v"), "OBJECT"), WINDOW_FAULTS[0]).when(~_is(field("thought"), "STRING"), WINDOW_FAULTS[1])
        .when(~_is(field("unit_id"), "STRING") | (T.strip(F.coalesce(_text(field("unit_id")), F.lit(""))) == ""), WINDOW_FAULTS[2])
        .when(~_is(field("actions"), "ARRAY"), WINDOW_FAULTS[3]).when(~_is(field("window_complete"), "BOOLEAN"), WINDOW_FAULTS[4])
    )
    v = v.withColumn("_window", window).withColumn("_status", F.coalesce("_window", "_fault.fault", F.lit("valid")))
    own = F.from_json(F.col(value), "actions array<string>")["actions"]
    calls = F.transform(F.arrays_zip(F.col("_calls.tool").alias("tool"), F.col("_ids").alias("id"), own.alias("own")), lambda c: F.struct(c["id"].alias("action_id"), c["tool"].alias("tool"), _arguments(c["own"]).alias("arguments")))
    valid = F.col("_status") == "valid"
    return v.select(
        *lines.columns, F.when(_is(field("unit_id"), "STRING"), _text(field("unit_id"))).alias("unit_id"), F.when(_is(field("thought"), "STRING"), _text(field("thought"))).alias("thought"),
        F.when(_is(field("window_complete"), "BOOLEAN"), _get(F.col("_v"), "$.window_complete", "boolean")).alias("window_complete"), F.col("_status").alias("status"),
        F.when(F.col("_window").isNull(), (F.col("_fault.k") + 1).cast("int")).alias("fault_at"), F.when(valid, calls).cast(CALLS).alias("calls"),
    )


def require_valid(windows: DataFrame) -> DataFrame:
    """Checked windows, or an error that names the unit and the rule as the result is read."""
    told = F.concat(F.lit("window "), F.coalesce("unit_id", F.lit("?")), F.lit(": "), "status", F.coalesce(F.concat(F.lit(" in call "), F.col("fault_at").cast("string")), F.lit("")))
    return windows.where(F.when(F.col("status") == "valid", F.lit(True)).otherwise(F.raise_error(told)))


def model_text(tool: str, arguments: dict) -> str:
    """What a model sees of a call: compact JSON, the arguments that name a target first and in the order of TARGET_KEYS, others as they came."""
    place = {key: k for k, key in enumerate(TARGET_KEYS)}
    told = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    pairs = ",".join(f"{told(key)}:{told(arguments[key])}" for key in sorted(arguments, key=lambda key: place.get(key, len(place))))
    return f'[ACTION] {{"function":{told(tool)},"args":{{{pairs}}}}}'


@F.pandas_udf(ArrayType(StringType()))
def _texts(calls: pd.Series) -> pd.Series:
    return calls.map(lambda c: None if c is None else [model_text(x["tool"], json.loads(x["arguments"])) for x in c])


def with_model_texts(windows: DataFrame) -> DataFrame:
    """Checked windows with actions: action_id, tool, arguments and model_text of each call."""
    d = windows.withColumn("_texts", _texts(F.col("calls")))
    return d.withColumn("actions", F.zip_with("calls", "_texts", lambda c, t: F.struct(c["action_id"].alias("action_id"), c["tool"].alias("tool"), c["arguments"].alias("arguments"), t.alias("model_text")))).drop("_texts", "calls")
