"""Audit of files: paths, sizes, secrets, machine paths."""

from __future__ import annotations

import ast
import uuid
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.sources.shared import written

# --- fixed values ---
FORBIDDEN_PARTS = (".codex", ".sii", "__pycache__", "checkpoints", "models", "logs")
ASSIGNMENT = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*[=:]\s*(.*?)\s*$"
INLINE = r"(?:^|[^A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)[ \t]*[=:][ \t]*([^ \t]+)"
CREDENTIAL = r"(?i)api[_-]?key|secret|token|password"
#: What CREDENTIAL matches, in lower case.
CREDENTIAL_WORDS = ("apikey", "api_key", "api-key", "secret", "token", "password")
PLACEHOLDERS = ("<secret>", "<api-key>")
LOOKUPS = ("os.environ", "os.getenv", "environ.get")
MAX_BYTES = 10 * 1024 * 1024
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def is_forbidden_path(path: Column) -> Column:
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    env = (name == ".env") | (name.startswith(".env.") & (name != ".env.example"))
    return env | F.arrays_overlap(parts, F.array(*map(F.lit, FORBIDDEN_PARTS)))


def may_tell(text: Column) -> Column:
    """Whether a credential's word is in a text: a search of bytes, before any pattern."""
    return F.exists(F.array(F.lower(text)), lambda t: reduce(Column.__or__, (t.contains(w) for w in CREDENTIAL_WORDS)))


def secret_lines(files: DataFrame, anchored: bool = True) -> DataFrame:
    """Secret lines of files (path, content); only files that have a credential's word are split."""
    return text_lines(files.where(may_tell(F.col("content")))).where(is_secret_line(F.col("line"), anchored))


def is_secret_line(line: Column, anchored: bool = True) -> Column:
    """A credential-like name with a value that is no placeholder. anchored: the line is the assignment."""
    pattern = ASSIGNMENT if anchored else INLINE
    name, value = F.regexp_extract(line, pattern, 1), F.btrim(T.strip(F.regexp_extract(line, pattern, 2)), F.lit("\"'"))
    return may_tell(line) & line.rlike(pattern) & name.rlike(CREDENTIAL) & (value != "") & ~value.contains("example.invalid") & ~value.isin(*PLACEHOLDERS)


def python_literal(value: str) -> bool:
    """Whether a Python right-hand side is a non-empty string of its own."""
    value = value.strip().rstrip(",")
    if value.startswith(LOOKUPS):
        return False
    try:
        found = ast.literal_eval(value)
    except (SyntaxError, ValueError):
        return False
    return isinstance(found, str) and bool(found.strip())


def unfenced(lines: DataFrame, key: str = "path", at: str = "line_no", line: str = "line") -> DataFrame:
    """Lines of Markdown outside fenced blocks; the fences go too."""
    fence = T.strip(F.col(line)).startswith("```")
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_n", F.count_if(fence).over(w)).where((F.col("_n") % 2 == 0) & ~fence).drop("_n")


def text_lines(files: DataFrame) -> DataFrame:
    """path, line_no and line of files (path, content)."""
    return files.select("path", F.posexplode(F.split("content", LINE_END, -1)).alias("line_no", "line"))


def audit(files: DataFrame, machine_marker: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(code, path, detail) issues of files (path, content BINARY, bytes), in order; files that aren't UTF-8 have no content to check.

    One pass: each file makes its list of issues in its row. Large files are read like others.
    """
    @F.pandas_udf("boolean")
    def literal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: any(map(python_literal, v)))

    suffix = F.lower(F.regexp_extract("path", r"(?<=[^/])(\.[^./]*)$", 1))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    d = files.select("path", "bytes", suffix.alias("suffix"), text.alias("text"))
    lines = F.split("text", LINE_END, -1)
    # fences toggle; a line is outside after an even number of them
    state = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))
    step = lambda s, x: F.when(T.strip(x).startswith("```"), F.struct((s["n"] + 1).alias("n"), s["kept"].alias("kept"))).otherwise(F.struct(s["n"].alias("n"), F.when(s["n"] % 2 == 0, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept")))
    # of Markdown only lines that are fences or assignments matter here, so that the fold stays short
    telling = F.filter(lines, lambda x: T.strip(x).startswith("```") | is_secret_line(x))
    d = d.withColumn("found", F.when(F.col("suffix") == ".md", F.filter(F.aggregate(telling, state, step, lambda s: s["kept"]), lambda x: is_secret_line(x))).otherwise(F.filter(lines, lambda x: is_secret_line(x))))
    d = d.withColumn("values", F.transform("found", lambda x: F.regexp_extract(x, ASSIGNMENT, 2)))
    python = F.col("suffix") == ".py"
    secret = F.coalesce(F.size("found") > 0, F.lit(False)) & (~python | literal(F.when(python, F.col("values")).otherwise(F.array().cast("array<string>"))))
    marked = F.coalesce((F.col("suffix") != ".md") & F.col("text").contains(machine_marker), F.lit(False))
    issue = lambda when, code, detail: F.when(when, F.struct(F.lit(code).alias("code"), F.col("path"), detail.alias("detail")))
    every = F.array(
        issue(is_forbidden_path(F.col("path")), "forbidden_path", F.lit("path must not be tracked")),
        issue(F.col("bytes") > max_bytes, "file_too_large", F.concat(F.col("bytes").cast("string"), F.lit(f" bytes exceeds {max_bytes}"))),
        issue(secret, "possible_secret", F.lit("non-empty credential-like assignment")),
        issue(marked, "machine_absolute_path", F.lit(f"contains {machine_marker}")),
    )
    return d.select(F.inline(F.filter(every, lambda x: x.isNotNull()))).orderBy("code", "path", "detail")


def format_issues(issues: DataFrame) -> DataFrame:
    return issues.select(F.concat_ws(": ", "code", "path", "detail").alias("line"))


def manifest(files: DataFrame) -> DataFrame:
    """path, bytes and sha256 of files (path, content BINARY), by path."""
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


#: Characters of the passages that one automaton holds, about; a passage counts for ROW_CHARS more.
PART_CHARS = 1 << 20
ROW_CHARS = 64
#: Pairs that are sent on at once.
PAIRS = 1 << 16

_built: dict[str, tuple] = {}


def _automaton(name: str, passages: pa.Table) -> tuple:
    """The automaton of a part's distinct passages, the rows of each, and the numbers of empty ones; the last one built stays for the worker's next task."""
    import ahocorasick

    if name not in _built:
        _built.clear()
        rows: dict[str, list[int]] = {}
        for k, text in enumerate(passages.column("passage").to_pylist()):
            rows.setdefault(text, []).append(k)
        found = ahocorasick.Automaton()
        for k, text in enumerate(rows):
            if text:
                found.add_word(text, k)
        found.make_automaton()
        _built[name] = found, list(rows.values()), [k for k, text in enumerate(rows) if not text]
    return _built[name]


def passages_within(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, doc_id of each passage (item_id, text) that a text (doc_id, text) contains whole; null texts contain nothing.

    The passages are dealt into parts of about PART_CHARS characters by hash. Each part is broadcast, and texts run through its
    automaton in Arrow batches, where they are: a text costs its length for each part, whatever the passages, and isn't shuffled.
    An empty passage is in every text. Equal passages are searched once a part. An empty table of either gives no rows.
    """
    spark = texts.sparkSession
    p = passages.select("item_id", F.col("text").cast("string").alias("passage")).where("passage is not null")
    chars = p.agg(F.sum(F.length("passage").cast("long") + ROW_CHARS)).first()[0] or 0
    parts = -(-chars // PART_CHARS)
    schema = f"item_id {passages.schema['item_id'].dataType.simpleString()}, doc_id {texts.schema['doc_id'].dataType.simpleString()}"
    if not parts:
        return spark.createDataFrame([], schema)
    dealt = p.withColumn("_part", F.pmod(F.xxhash64("item_id", "passage"), F.lit(parts)))
    if parts > 1:
        dealt = written(dealt.repartition("_part"), "passages")
    out = None
    for k in range(parts):
        name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(dealt.where(F.col("_part") == k).select("item_id", "passage").toArrow())

        def within(batches, name=name, shared=shared):
            found, rows, empty = _automaton(name, shared.value)
            items = shared.value.column("item_id").combine_chunks()
            pairs = lambda b, item, doc: pa.RecordBatch.from_arrays([items.take(pa.array(item, pa.int64())), b.column("doc_id").take(pa.array(doc, pa.int64()))], names=["item_id", "doc_id"])
            for b in batches:
                item, doc = [], []
                for i, text in enumerate(b.column("text")):
                    if (text := text.as_py()) is None:
                        continue
                    for v in {*empty, *(v for _, v in (found.iter(text) if len(found) else ()))}:
                        item += rows[v]
                        doc += [i] * len(rows[v])
                        if len(item) > PAIRS:
                            yield pairs(b, item, doc)
                            item, doc = [], []
                yield pairs(b, item, doc)

        one = texts.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(within, schema)
        out = one if out is None else out.unionByName(one)
    return out
