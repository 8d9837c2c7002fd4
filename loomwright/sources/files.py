"""Readers and writers of transcript files."""

from __future__ import annotations

import csv
import glob
import hashlib
import json
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.operators.windows import checked_windows, require_valid, with_model_texts
from loomwright.sources.shared import written
from loomwright.sources.sinks import JsonFiles

MANIFEST_SCHEMA = "dataset_manifest_v1"


#: Most splits of all shards whose places are broadcast; beyond, they are joined by shuffle.
SPLITS = 100_000


def _places(batches: Iterator[pa.RecordBatch], state: dict) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch of lines (file, block, value) with the ordinal of each line that isn't blank and its offset, both within its split; state: what each split has so far."""
    for b in batches:
        n = b.num_rows
        blank = pc.equal(pc.utf8_trim_whitespace(b.column("value")), "").to_numpy(zero_copy_only=False)
        size = pc.binary_length(b.column("value")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        file, block = b.column("file").to_pylist(), b.column("block").to_pylist()
        row, offset = np.empty(n, np.int64), np.empty(n, np.int64)
        at = 0
        while at < n:
            key = file[at], block[at]
            end = at + 1
            while end < n and (file[end], block[end]) == key:
                end += 1
            rows, chars = state.get(key, (0, 0))
            count, total = np.cumsum(~blank[at:end]), np.cumsum(size[at:end])
            row[at:end], offset[at:end] = rows + count - 1, chars + total - size[at:end]
            state[key] = rows + int(count[-1]), chars + int(total[-1])
            at = end
        yield b, blank, row, offset


def read_jsonl(spark: SparkSession, path: str, names: str = "*.jsonl") -> DataFrame:
    """Lines of *.jsonl files (or those of other names) with their place: source_file, source_row (of lines that aren't blank), source_offset (bytes), value.

    From any store that Spark reads; large shards are split. Lines end at a newline only. A line that is no JSON aborts, naming
    shard and row, as the result is read. Places come from the counts of the splits before, which a first pass makes.
    """
    try:
        lines = spark.read.text(f"{path.rstrip('/')}/{names}", lineSep="\n")
    except AnalysisException as e:
        raise ValueError(f"no {names} under {path}") from e
    lines = lines.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def totals(batches):
        state: dict = {}
        for _ in _places(batches, state):
            pass
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in state]), pa.array([k[1] for k in state], pa.int64()), *(pa.array([v[j] for v in state.values()], pa.int64()) for j in range(2))], names=["file", "block", "rows", "bytes"])

    def placed(batches):
        for b, blank, row, offset in _places(batches, {}):
            kept = pa.array(~blank)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(row), pa.array(offset), b.column("value")], names=["file", "block", "row", "offset", "value"]).filter(kept)

    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lines.mapInArrow(totals, "file string, block long, rows long, bytes long")
    before = before.select("file", "block", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("rows", "bytes")))
    before = written(before, "splits")
    if before.count() <= SPLITS:
        before = F.broadcast(before)
    d = lines.mapInArrow(placed, "file string, block long, row long, offset long, value string").join(before, ["file", "block"])
    d = d.select(F.col("file").alias("source_file"), (F.col("row") + F.col("rows")).alias("source_row"), (F.col("offset") + F.col("bytes")).alias("source_offset"), "value")
    wrong = F.raise_error(F.concat("source_file", F.lit(" row "), F.col("source_row").cast("string"), F.lit(" is no JSON")))
    return d.where(F.when(F.try_parse_json("value").isNotNull(), F.lit(True)).otherwise(wrong))


def read_jsonl_plain(spark: SparkSession, path: str) -> DataFrame:
    """Lines without places, from any store that Spark reads."""
    return spark.read.text(path, lineSep="\n").where(F.trim("value") != "").select(F.col("_metadata.file_name").alias("source_file"), "value")


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    return rows.withColumn("record", F.from_json("value", schema, {"mode": "PERMISSIVE"}))


def lookup(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected rows (source_file, source_row), in one pass over rows; one that isn't there is an error, raised as the result is read."""
    want = selected.select("source_file", "source_row").distinct()
    found = want.join(rows.withColumn("_found", F.lit(True)), ["source_file", "source_row"], "left")
    missing = F.raise_error(F.concat(F.lit("no such row: "), "source_file", F.lit(" "), F.col("source_row").cast("string")))
    return found.where(F.when(F.col("_found"), F.lit(True)).otherwise(missing)).select(rows.columns)


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    """A directory of JSON files: name and body as VARIANT; anything but an object is an error."""
    d = spark.read.text(os.path.join(path, "*.json"), wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.parse_json("value").alias("body"))
    return d.where(F.when(F.schema_of_variant("body").startswith("OBJECT"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not an object: "), "name")))).orderBy("name")


def read_json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Rows of a JSON-lines file by a schema; blank lines are skipped; a line that is no such object, a repeated key and an empty file are errors."""
    lines = spark.read.text(path, lineSep="\n").where(F.trim("value") != "").select("value", F.try_parse_json("value").alias("v"))
    good = F.schema_of_variant("v").startswith("OBJECT")
    d = lines.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.left("value", F.lit(60))))))
    d = d.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    n = d.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.min(F.when(F.col("n") > 1, F.col(key))).alias("twice")).first()
    if not n["keys"]:
        raise ValueError(f"no rows in {path}")
    if n["twice"] is not None:
        raise ValueError(f"repeated {key}: {n['twice']}")
    return d


#: Schema of references and predictions.
UNITS = (
    "unit_id string, case_type string, status string, step_label string, intents array<struct<intent_id:string,intent_quote:string,temporal_scope:string>>, "
    "pairs array<struct<intent_id:string,action_id:string,operation_match:string>>"
)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Windows of a JSON-lines file with their calls and what a model sees of each; a window that breaks a rule, a repeated unit and an empty file are errors."""
    lines = spark.read.text(path, lineSep="\n").where(F.trim("value") != "")
    checked = with_model_texts(require_valid(checked_windows(lines)))
    n = checked.groupBy("unit_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.min(F.when(F.col("n") > 1, F.col("unit_id"))).alias("twice")).first()
    if not n["keys"]:
        raise ValueError(f"no rows in {path}")
    if n["twice"] is not None:
        raise ValueError(f"repeated unit_id: {n['twice']}")
    kinds = F.from_json("value", "test_type string, case_type string")
    return checked.select("unit_id", "thought", "window_complete", "actions", kinds["test_type"].alias("test_type"), kinds["case_type"].alias("case_type"))


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """References or predictions."""
    return read_json_lines(spark, path, UNITS, "unit_id")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Small files with content, size and digest."""
    d = spark.read.format("binaryFile").load(path)
    return d.select("path", F.col("length").alias("bytes"), "content", F.sha2("content", 256).alias("sha256"))


def digest_files(spark: SparkSession, paths: Sequence[str], chunk: int = 1 << 20) -> DataFrame:
    """path, bytes and sha256 of files that may be large: executors stream them."""

    def run(batches):
        for b in batches:
            out = []
            for p in b["path"]:
                h, n = hashlib.sha256(), 0
                with open(p, "rb") as f:
                    while part := f.read(chunk):
                        h.update(part)
                        n += len(part)
                out.append((n, h.hexdigest()))
            b["bytes"], b["sha256"] = zip(*out, strict=True) if out else ([], [])
            yield b

    d = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return d.mapInPandas(run, "path string, bytes long, sha256 string")


def tracked_files(root: str) -> list[str]:
    out = subprocess.run(["git", "ls-files", "-z"], cwd=root, capture_output=True, check=True).stdout
    return sorted(x for x in out.decode().split("\0") if x)


@dataclass(frozen=True)
class Prompts:
    system: str
    user_template: str


def read_prompts(path: str, headings: tuple[str, str] = ("System", "User")) -> Prompts:
    """Two required Markdown sections with bodies."""
    text = Path(path).read_text(encoding="utf-8")
    bodies = []
    for h in headings:
        m = re.search(rf"(?ms)^##? {re.escape(h)}[^\n]*\n(.*?)(?=^##? |\Z)", text)
        if not m or not m[1].strip():
            raise ValueError(f"{path}: section {h} is missing or empty")
        bodies.append(m[1].strip())
    return Prompts(*bodies)


def data_root(explicit: str | None = None, environ: Mapping[str, str] | None = None, variable: str = "DATA_ROOT") -> Path:
    value = explicit or (os.environ if environ is None else environ).get(variable)
    if not value:
        raise ValueError(f"no data root: pass one or set {variable}")
    if not Path(value).is_dir():
        raise ValueError(f"not a directory: {value}")
    return Path(value).resolve()


def under_root(root: Path, relative: str) -> Path:
    """A path inside root; absolute ones and such as lead out are errors."""
    if Path(relative).is_absolute() or not (found := (root / relative).resolve()).is_relative_to(root.resolve()):
        raise ValueError(f"outside of the data root: {relative}")
    return found


def portable_name(path: Column, root: str) -> Column:
    """Relative to root with /, else the file's name."""
    prefix = root.rstrip("/") + "/"
    plain = F.regexp_replace(path, "^file:/+", "/")
    return F.when(plain.startswith(prefix), F.substring(plain, F.lit(len(prefix) + 1), F.length(plain))).otherwise(F.substring_index(plain, "/", -1))


# --- sinks ------------------------------------------------------------------------------------------------------------


def atomic_json(path: str, value: object) -> None:
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.write("\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def atomic_copy(source: str, target: str) -> None:
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    part = f"{target}.part"
    shutil.copyfile(source, part)
    os.replace(part, target)


def write_case_files(cases: DataFrame, folder: str) -> int:
    """One JSON file for each case, written by tasks and put in place together; files of other cases there, and repeated cases, are errors. Returns their number."""
    os.makedirs(folder, exist_ok=True)
    cases.sparkSession.dataSource.register(JsonFiles)
    rows = cases.select(F.col("case_id").alias("name"), F.to_json(F.struct(*cases.columns), {"ignoreNullFields": "false"}).alias("body"))
    rows.write.format("json_files").option("prefix", "CASE-").mode("append").save(folder)
    return len(glob.glob(os.path.join(folder, "CASE-*.json")))


def write_report(value: object, path: str) -> None:
    """A JSON report that never replaces another."""
    if os.path.exists(path):
        raise FileExistsError(path)
    atomic_json(path, value)


def write_jsonl(d: DataFrame, path: str, overwrite: bool = False) -> None:
    d.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_manifest_csv(d: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A header and rows in order; arrays joined by |, missing values empty."""
    cols = [F.concat_ws("|", c) if d.schema[c].dataType.simpleString().startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in d.columns]
    have = [c for c in columns if c in d.columns]
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, columns, restval="")
        out.writeheader()
        for r in d.select(*(c.alias(n) for c, n in zip(cols, have, strict=True))).toLocalIterator():
            out.writerow(r.asDict())


def dataset_manifest(spark: SparkSession, name: str, version: str, root: Path, relative: Sequence[str], metadata: Mapping[str, object]) -> dict:
    if not name.strip() or not version.strip():
        raise ValueError("a manifest needs a name and a version")
    paths = {str(under_root(root, r)): r for r in relative}
    if missing := [r for p, r in paths.items() if not os.path.isfile(p)]:
        raise ValueError(f"missing: {missing[0]}")
    files = sorted(({"path": Path(paths[r["path"]]).as_posix(), "bytes": r["bytes"], "sha256": r["sha256"]} for r in digest_files(spark, list(paths)).collect()), key=lambda f: f["path"])
    return {"schema": MANIFEST_SCHEMA, "name": name, "version": version, "files": files, "file_count": len(files), "total_bytes": sum(f["bytes"] for f in files), "metadata": dict(metadata)}


def verify_files(folder: str, files: Sequence[Mapping[str, object]]) -> list[str]:
    """Problems of files against a lock (path, bytes, sha256): size first, then digest."""
    out = []
    for f in files:
        p = Path(folder) / str(f["path"])
        if not p.is_file() or p.stat().st_size != f["bytes"]:
            out.append(f"{f['path']}: size")
        elif hashlib.sha256(p.read_bytes()).hexdigest() != f["sha256"]:
            out.append(f"{f['path']}: sha256")
    return out
