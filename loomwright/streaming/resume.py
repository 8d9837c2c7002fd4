"""Resume as a stream: new units are read once, completed, and appended to a run's log."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.sources.files import atomic_json


def run_id(settings: Mapping[str, object]) -> str:
    """A run is its settings; other settings never reuse its results."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def open_run(folder: str, settings: Mapping[str, object]) -> None:
    """Claim a folder for a run: a new or empty one gets a manifest of the settings; another must have the same. A folder with other files is refused."""
    manifest = os.path.join(folder, "manifest.json")
    if os.path.isfile(manifest):
        with open(manifest, encoding="utf-8") as f:
            if json.load(f) != json.loads(json.dumps(settings)):
                raise ValueError(f"other settings than those of {folder}")
    elif os.path.isdir(folder) and os.listdir(folder):
        raise ValueError(f"files without a manifest in {folder}")
    else:
        atomic_json(manifest, dict(settings))


def process_new(spark: SparkSession, source: str, schema: str, log: str, checkpoint: str, settings: Mapping[str, object], step: Callable[[DataFrame], DataFrame], key: str = "unit_id", keep: str | None = None):
    """Read what came since the last run, pass each unit's first row to step once, and append the results (exactly once a batch).

    Which units were passed is keyed state in the checkpoint, in the JVM, so that a batch doesn't read the log. State and results
    of a batch that failed are made again together. keep: how long a unit is remembered (such as "30 days"), which bounds the
    state; one that comes again later is a new one. Units of a null key are one unit.
    """
    run = run_id(settings)

    def append(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{log}/run={run}/batch={number}")

    stream = spark.readStream.schema(schema).json(source)
    if keep is None:
        new = stream.dropDuplicates([key])
    else:
        new = stream.withColumn("_seen_at", F.current_timestamp()).withWatermark("_seen_at", keep).dropDuplicatesWithinWatermark([key]).drop("_seen_at")
    return new.writeStream.foreachBatch(append).option("checkpointLocation", f"{checkpoint}/{run}").trigger(availableNow=True).start()


def status_counts(units: DataFrame, window: str = "10 minutes", late: str = "1 hour", at: str = "finished_at") -> DataFrame:
    """Statuses by time window; units over `late` late are left out, so that state stays bounded."""
    return units.withWatermark(at, late).groupBy(F.window(at, window), "status").agg(F.count("*").alias("n"))
