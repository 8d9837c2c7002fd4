"""Registration of an external selection: validate it, copy its metadata and some samples, and write a manifest of its files."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import validation
from loomwright.sources import files

CASE = "case_id string, target boolean, model_name string, selection_group string"


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """file_name and the checked fields of each case file."""
    d = files.read_json_objects(spark, folder).where(F.col("name").startswith("CASE-"))
    field = lambda n, t: F.try_variant_get("body", f"$.{n}", t).alias(n)
    return d.select(F.col("name").alias("file_name"), *(field(*x.split()) for x in CASE.split(", ")))


def rules_of(spark: SparkSession, folder: str, expected: int, frozen: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """The snapshot's rules; a missing file is an error of its own."""
    for name in (f"selected_{expected}.jsonl", "manifest.csv", "selection_summary.json"):
        if not os.path.isfile(os.path.join(folder, name)):
            raise FileNotFoundError(os.path.join(folder, name))
    listed = spark.read.text(os.path.join(folder, f"selected_{expected}.jsonl"), lineSep="\n").where(F.trim("value") != "").select(F.get_json_object("value", "$.case_id").alias("case_id"))
    with open(os.path.join(folder, "selection_summary.json"), encoding="utf-8") as f:
        summary = json.load(f)
    return validation.snapshot_rules(read_cases(spark, folder), listed, files.read_csv(spark, os.path.join(folder, "manifest.csv")), summary, expected, frozen)


def import_snapshot(
    spark: SparkSession, data_root: str, source: str, shards: str, target: str, samples: Sequence[str], expected: int, name: str, version: str, frozen: Mapping[str, Mapping[str, int]] | None = None,
) -> dict:
    """Validate the snapshot at data_root/source, copy its manifest, summary and sample cases below target, and write target/dataset_manifest.json.

    Nothing is written unless every rule holds, all samples exist and there are shards.
    """
    root = Path(data_root).resolve()
    folder, raw = files.under_root(root, source), files.under_root(root, shards)
    validation.require_snapshot(rules_of(spark, str(folder), expected, frozen))
    validation.require_samples(samples, read_cases(spark, str(folder)))
    found = sorted(glob.glob(str(raw / "*.jsonl")))
    if not found:
        raise ValueError(f"no shards in {raw}")
    copies = {n: os.path.join(target, n) for n in ("manifest.csv", "selection_summary.json")} | {f"{s}.json": os.path.join(target, "samples", f"{s}.json") for s in samples}
    for n, path in copies.items():
        files.atomic_copy(str(folder / n), path)
    relative = [str(Path(p).resolve().relative_to(root)) for p in [folder / f"selected_{expected}.jsonl", folder / "manifest.csv", folder / "selection_summary.json", *found]]
    with open(folder / "selection_summary.json", encoding="utf-8") as f:
        summary = json.load(f)
    kept = {k: summary.get(k) for k in ("seed", "target_counts", "model_counts", "selection_group_counts", "unique_instance_ids", "unique_repositories")}
    manifest = files.dataset_manifest(spark, name, version, root, relative, {"source_relative": Path(source).as_posix(), "selected_count": expected} | kept)
    manifest["metadata"]["copies"] = [{"path": os.path.relpath(p, target), "bytes": r["bytes"], "sha256": r["sha256"]} for p, r in sorted((r["path"], r) for r in files.digest_files(spark, list(copies.values())).collect())]
    files.atomic_json(os.path.join(target, "dataset_manifest.json"), manifest)
    return {"selected_count": expected, "dataset_manifest": os.path.join(target, "dataset_manifest.json"), "sample_count": len(samples), "raw_shard_count": len(found)}
