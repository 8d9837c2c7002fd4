"""Scalar functions over agent messages; each takes and returns columns and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
#: White space as Python strips it.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FENCED = r"(?s)```[^\n`]*\n?(.*?)```"
WORD = r"[A-Za-z][A-Za-z'-]*"
DELIBERATION = (
    r"(?iU)\b(?:because|indicat(?:e|es|ed)|need|next|plan|should|suggest(?:s|ed)?|therefore|to (?:address|debug|fix|investigate|reproduce|verify)|we (?:can|will)|let(?:'s| us))\b"
)
BUG_WORDS = (
    r"(?iU)\b(?:bug|broken|cannot|can't|crash(?:es|ed|ing)?|doesn'?t|error|exception|fail(?:s|ed|ing|ure)?|fix|hang(?:s|ing)?|incorrect(?:ly)?|invalid|not work(?:ing)?|regression|traceback|unexpected|wrong)\b"
    r"|\b(?:attribute|index|key|runtime|type|value)error\b"
)
FEATURE_START = r"(?iU)^(?:add|allow|create|document|enhance|feature request|freeze|have an option|implement|introduce|log|option to|provide|refactor|report|support|treat)\b"
PROBLEM_WORDS = r"(?iU)\b(?:issue|problem|unexpected behavior)\b"
TEST_COMMAND = r"(?U)(?:^|\s)(?:pytest|tox|nosetests|go test|cargo test|npm test|yarn test|mvn test|gradle test|rspec|rake test)(?:\s|$)|python\s+[^\n]*test"
EDIT_COMMAND = r"(?U)(?:^|\n)(?:edit\b|create\b|apply_patch\b)|end_of_edit"
INSPECT_COMMAND = r"(?U)(?:^|\s)(?:search_dir|search_file|find_file|open|scroll_up|scroll_down|cat|sed|grep|rg|find|ls|head|tail)(?:\s|$)"
RUN_COMMAND = r"(?U)(?:^|\s)(?:python|node|ruby|java|bash|sh)\b"
TRUNCATED = "[Earlier context truncated]\n"
NO_CONTEXT = "[No preceding context]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, f"[{WHITE}]+", " "))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def is_bugfix(title: Column) -> Column:
    """Bug wording, unless the title starts as a feature does."""
    t = squeeze(text_or_empty(title))
    return (t != "") & ~t.rlike(FEATURE_START) & (t.rlike(BUG_WORDS) | t.rlike(PROBLEM_WORDS))


def is_explicit_thought(c: Column) -> Column:
    """At least 20 characters and 4 words, with a marker of deliberation."""
    t = strip(text_or_empty(c))
    return (F.length(t) >= 20) & (F.regexp_count(t, F.lit(WORD)) >= 4) & t.rlike(DELIBERATION)


def action_phase(c: Column) -> Column:
    """test, edit, inspect, run or other: the first that fits."""
    t = F.lower(strip(text_or_empty(c)))
    return F.when(t.rlike(TEST_COMMAND), "test").when(t.rlike(EDIT_COMMAND), "edit").when(t.rlike(INSPECT_COMMAND), "inspect").when(t.rlike(RUN_COMMAND), "run").otherwise("other")


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def last_block(c: Column) -> Column:
    """Struct (thought, action) of a message's last fenced block; null without one."""
    t = text_or_empty(c)
    whole = F.element_at(F.regexp_extract_all(t, F.lit(FENCED), F.lit(0)), -1)
    inner = F.element_at(F.regexp_extract_all(t, F.lit(FENCED), F.lit(1)), -1)
    rest = F.element_at(F.split(t, FENCED, -1), -1)
    block = F.struct(strip(F.left(t, F.length(t) - F.length(rest) - F.length(whole))).alias("thought"), strip(inner).alias("action"))
    return F.when(t.rlike(FENCED), block)


def issue_text(messages: Column) -> Column:
    """The first user message that isn't blank, after its `ISSUE:` mark if it has one."""
    said = F.transform(F.filter(messages, lambda m: (m["role"] == "user") & (strip(text_or_empty(m["text"])) != "")), lambda m: strip(m["text"]))
    first = F.coalesce(F.get(said, F.lit(0)), F.lit(""))
    mark = r"(?isU)\bISSUE:\s*(.*)"
    return F.when(first.rlike(mark), F.regexp_extract(first, mark, 1)).otherwise(first)


def issue_title(issue: Column) -> Column:
    """First line that isn't blank, without heading marks, up to 500 characters."""
    lines = F.filter(F.transform(F.split(text_or_empty(issue), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1), strip), lambda x: x != "")
    return F.left(strip(F.btrim(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.lit("#"))), F.lit(500))


def length_band(cycles: Column) -> Column:
    return F.when(cycles < 20, "10-19").when(cycles < 40, "20-39").otherwise("40+")


def stable_jitter(uid: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 64 bits of a digest."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), uid.cast("string")), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def uid(file: Column, row: Column) -> Column:
    """A record's name by its place: file:row."""
    return F.concat(file, F.lit(":"), row.cast("string"))


def identity(own: Column, file_name: Column) -> Column:
    """A trajectory's own id, or the stem of its file's name."""
    return F.coalesce(F.nullif(text_or_empty(own), F.lit("")), F.regexp_replace(file_name, r"(?<=[^/])\.[^./]*$", ""))


def repository(instance: Column) -> Column:
    return F.regexp_replace(instance, "-[^-]*$", "")


def model_short(name: Column) -> Column:
    return F.substring_index(name, "-", -1)


def quality_score(cycles: Column, ratio: Column, mean_chars: Column, phases: Column, patch_ok: Column, log_ok: Column, log_chars: Column) -> Column:
    """Up to 100 points: cycles, thought, variety of phases, evidence, length."""
    has = lambda p, n: F.when(F.array_contains(phases, p), float(n)).otherwise(0.0)
    point = lambda ok: F.when(ok, 5.0).otherwise(0.0)
    cycle = F.lit(15.0) + F.lit(15.0) * F.least(F.greatest(cycles - 10, F.lit(0)) / F.lit(30.0), F.lit(1.0))
    thought = F.lit(15.0) * ratio + F.lit(10.0) * F.least(mean_chars / F.lit(350.0), F.lit(1.0))
    variety = has("inspect", 5) + has("edit", 5) + has("test", 6) + has("run", 2) + has("other", 2)
    evidence = point(patch_ok) + point(log_ok) + point(F.array_contains(phases, "test") | (log_chars >= 1000))
    return cycle + thought + variety + evidence + F.when(cycles.between(15, 50), 10.0).otherwise(8.0)


def clip_context(c: Column, chars: int) -> Column:
    """The last characters of a text, marked where some are missing."""
    return F.when(F.length(c) <= chars, c).otherwise(F.concat(F.lit(TRUNCATED), F.right(c, F.lit(chars))))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(x, F.lit(-700.0)), F.lit(700.0))))


def three_way(x: Column, threshold: float, margin: float) -> Column:
    """yes, no or uncertain, round a threshold."""
    return F.when(x >= threshold + margin, "yes").when(x < threshold - margin, "no").otherwise("uncertain")


def template_key(c: Column) -> Column:
    """A task's wording with its particulars as placeholders."""
    t = F.lower(squeeze(text_or_empty(c)))
    for pattern, name in ((r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"), (r"\"[^\"]*\"|'[^']*'", "<quote>"), (r"(?:/[a-z0-9_.-]+){2,}", "<path>"), (r"[0-9]+", "<n>")):
        t = F.regexp_replace(t, pattern, name)
    return t


def approximate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / F.lit(4)).cast("long")


def only_string(v: Column) -> Column:
    """A VARIANT's text; empty for anything but a string."""
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")), F.lit(""))


def parse_object(c: Column) -> Column:
    """A model's answer as VARIANT: one code fence round the whole is taken off; null unless it is a JSON object."""
    t = strip(text_or_empty(c))
    body = F.regexp_extract(t, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    v = F.try_parse_json(F.when(t.rlike(r"(?is)^```(?:json)?\s*(.*?)\s*```$"), body).otherwise(t))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def render_step(step: Column) -> Column:
    """Three lines of a finished step."""
    line = lambda name, field, empty: F.concat(F.lit(f"{name} "), F.coalesce(step["step"].cast("string"), F.lit("None")), F.lit(": "), F.when(strip(text_or_empty(step[field])) != "", strip(step[field])).otherwise(empty))
    return F.concat_ws("\n", line("THOUGHT", "thought", "[empty thought]"), line("ACTION", "action", "[empty action]"), line("OBSERVATION", "observation", "[empty observation]"))


def build_prompt(template: str, step: Column, request: Column, context: Column, thought: Column) -> Column:
    """A user's template with four slots filled; the current action has no slot."""
    filled = F.lit(template)
    slots = {"thought_step": step.cast("string"), "user_request": F.when(request != "", request).otherwise("[No user request provided]"), "preceding_context": F.when(context != "", context).otherwise(NO_CONTEXT), "thought": F.when(thought != "", thought).otherwise("[Empty observable Thought]")}
    pieces, rest = [], template
    import re

    for m in re.finditer(r"\{(thought_step|user_request|preceding_context|thought)\}", template):
        pieces += [F.lit(template[len(template) - len(rest) : m.start()]), slots[m[1]]]
        rest = template[m.end() :]
    filled = F.concat(*pieces, F.lit(rest)) if pieces else filled
    return filled


def round_exact(c: Column, digits: int) -> Column:
    """A double to some decimals, by its exact binary value, half to even, as Python rounds; null, NaN and infinities stay.

    x * 10**digits is a double p and the error that its rounding made, found exactly by halves of the factors; the fraction of p
    and that error decide. The whole number over 10**digits is then the double next to the decimal. From 2**52 units on a double
    has no decimals left to round.
    """
    unit = 10.0**digits
    split = lambda a: 134217729.0 * a - (134217729.0 * a - a)  # noqa: E731  2**27 + 1: the upper half of a's bits
    high = split(unit)
    x = F.abs(c.cast("double"))
    p, xh = x * unit, split(x)
    low = unit - high
    xl = x - xh
    error = xl * low - (((p - xh * high) - xl * high) - xh * low)
    whole = F.floor(p).cast("double")
    over = (p - whole) - 0.5  # exact; the error counts only where it is 0
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    rounded = F.when(up, whole + 1).otherwise(whole) / unit
    sign = F.when(c < 0, -1.0).otherwise(1.0)
    return F.when(F.coalesce(p < 2.0**52, F.lit(False)), sign * rounded).otherwise(c.cast("double"))
