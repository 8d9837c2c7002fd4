"""Model calls behind injected clients: retries, statuses, resume. A row's error is a column, never a lost row."""

from __future__ import annotations

import math
import os
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwright.functions import text as T
from loomwright.operators.alignment import candidate_pairs, intent_results, step_labels, unit_status
from loomwright.operators.clients import TokenBucket
from loomwright.operators.validation import extraction_status
from loomwright.sources.shared import written

#: The largest pair that settings may allow.
MOST_PAIR_TOKENS = 8192
DONE = ("success", "skipped_empty")


class Client(Protocol):
    """Answers a request with a text and its usage counts; any exception is tried again."""

    def __call__(self, payload: dict) -> tuple[str, dict[str, int]]: ...


def chat_payload(prompt: str, model: str, system: str) -> dict:
    return {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "temperature": 0, "max_tokens": 4000, "response_format": {"type": "json_object"}, "stream": False}


def call(client: Client, payload: dict, accept: Callable[[str], object], tries: int, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, dict, int, str | None]:
    """Answer, usage, attempts and error; a transport error, a bad answer or an empty one is tried again, ever later."""
    error = None
    for k in range(1, tries + 1):
        try:
            answer, usage = client(payload)
            if not answer:
                raise ValueError("empty answer")
            accept(answer)
        except Exception as e:  # noqa: BLE001  whatever a client raises
            error = f"{type(e).__name__}: {e}"
            if k < tries:
                sleep(max(min(2 ** (k - 1) + random.random(), 8), getattr(e, "wait", 0)))
        else:
            return answer, {u: n for u, n in usage.items() if type(n) is int}, k, None
    return None, {}, tries, error


def complete(
    steps: DataFrame, client: Client, accept: Callable[[str], object], model: str, system: str, tries: int = 3, dry_run: bool = False, workers: int = 1, rate: float | None = None, burst: int = 1, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """steps (with prompt and thought) and their answer, usage, attempts, status, error.

    Each partition calls `workers` at a time and keeps the order of its rows; rate: calls a second that a partition starts, tries
    counted, with `burst` at once. An error whose `wait` a server set is tried again no sooner.
    """
    extra = "answer string, usage map<string,bigint>, attempts int, status string, error string"
    schema = StructType([*steps.schema.fields, *StructType.fromDDL(extra).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = None if rate is None else TokenBucket(rate, burst)

        def limited(payload: dict) -> tuple[str, dict[str, int]]:
            if bucket is not None:
                bucket.take()
            return client(payload)

        def one(prompt: str, thought: str | None) -> tuple:
            if not (thought or "").strip():
                return None, {}, 0, "skipped_empty", None
            if dry_run:
                return None, {}, 0, "dry_run", None
            answer, usage, n, error = call(limited, chat_payload(prompt, model, system), accept, tries, sleep)
            return answer, usage, n, "error" if error else "success", error

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                rows = list(pool.map(one, b["prompt"], b["thought"]))
                yield pd.concat([b.reset_index(drop=True), pd.DataFrame(rows, columns=["answer", "usage", "attempts", "status", "error"])], axis=1)

    return steps.mapInPandas(run, schema)


def empty_result(step: Column) -> Column:
    """The result of a step whose thought is empty: no intents, and why."""
    intents = F.array().cast("array<struct<intent_id:string,intent_text:string,source_quote:string>>")
    return F.struct(step.cast("long").alias("thought_step"), intents.alias("execution_intents"), F.lit("The observable Thought is empty.").alias("no_intent_reason"))


def merge_resume(fresh: DataFrame, old: DataFrame, keys: tuple[str, ...] = ("trajectory_id", "thought_step", "thought", "config_hash")) -> DataFrame:
    """fresh steps with `old_status` where a step with the same key is done; of repeated old steps the last counts. old has `written_at`."""
    last = old.groupBy(*keys).agg(F.max_by("status", "written_at").alias("old_status")).where(F.col("old_status").isin(*DONE))
    return fresh.join(last, list(keys), "left")


def remaining(units: DataFrame, done: DataFrame, key: str = "unit_id") -> DataFrame:
    return units.join(done.select(key), key, "left_anti")


def record_status(done: Column, dry: Column) -> Column:
    """Aggregate: completed if every step is done (or there is none); dry_run; else partial."""
    return F.when(F.coalesce(F.bool_and(done), F.lit(True)), "completed").when(F.bool_and(done | dry), "dry_run").otherwise("partial")


def usage_by_key(records: DataFrame, usage: str = "usage") -> DataFrame:
    return records.select(F.explode(usage).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def length_batches(items: list[tuple[int, int]], batch_size: int, long: int = 4096) -> list[list[int]]:
    """Batches of (index, tokens): by length, those over `long` alone."""
    out: list[list[int]] = []
    for index, tokens in sorted(items, key=lambda x: (x[1], x[0])):
        if tokens > long or not out or len(out[-1]) >= batch_size:
            out.append([index])
        else:
            out[-1].append(index)
    return out


def check_bounds(threshold: float, margin: float, batch_size: int, max_pair_tokens: int, max_new_tokens: int) -> None:
    """An error for settings that no run may have."""
    if not (math.isfinite(threshold) and math.isfinite(margin)) or margin < 0:
        raise ValueError("threshold and margin must be finite, and the margin not negative")
    if min(batch_size, max_pair_tokens, max_new_tokens) < 1 or max_pair_tokens > MOST_PAIR_TOKENS:
        raise ValueError(f"sizes must be positive, and pairs have {MOST_PAIR_TOKENS} tokens at most")


def require_subset(done: DataFrame, units: DataFrame, key: str = "unit_id") -> DataFrame:
    """done, or an error if it repeats a key or has one that units lack."""
    n = F.count("*")
    d = done.groupBy(key).agg(n.alias("n")).join(units.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
    worst = d.where("n > 1 or known is null").agg(F.min(key).alias("k")).first()["k"]
    if worst is not None:
        raise ValueError(f"finished {key} repeated or unknown: {worst}")
    return done


def folder_fingerprint(path: str) -> dict[str, dict[str, int]]:
    """Bytes and time of change of each file of a model's folder."""
    if not os.path.isdir(path):
        raise ValueError(f"not a folder: {path}")
    with os.scandir(path) as found:
        return {f.name: {"bytes": f.stat().st_size, "mtime_ns": f.stat().st_mtime_ns} for f in found if f.is_file()}


def score_pairs(pairs: DataFrame, scorer: Callable[[list[str]], list[float]], max_tokens: int = MOST_PAIR_TOKENS, batch_size: int = 4, threshold: float = 0.0, margin: float = 0.0, long: int = 4096) -> DataFrame:
    """pairs (text, input_tokens) with logit, operation_match, reason, beyond_512, padded_tokens and error.

    Pairs are dealt by ranges of length and put in order, so that a batch holds neighbours in length whatever the Arrow batches
    are; those over `long` go alone. padded_tokens: the longest pair of its batch, which a model pads to (null: not scored).
    Too long or out of memory is uncertain with a reason. Anything else that goes wrong with a batch, such as a logit that isn't
    finite, is its rows' error: their units fail, the job goes on.
    """
    check_bounds(threshold, margin, batch_size, max_tokens, 1)
    schema = StructType([*pairs.schema.fields, *StructType.fromDDL("logit double, operation_match string, reason string, beyond_512 boolean, padded_tokens int, error string").fields])

    def scored(b: pd.DataFrame, batches: list[list[int]]) -> pd.DataFrame:
        n = len(b)
        logit, match, padded, error = [None] * n, ["uncertain"] * n, [None] * n, [None] * n
        reason = ["context_overflow" if t > max_tokens else None for t in b["input_tokens"]]
        for some in batches:
            for i in some:
                padded[i] = int(max(b["input_tokens"].iloc[j] for j in some))
            try:
                values = scorer([b["text"].iloc[i] for i in some])
                if len(values) != len(some) or not all(math.isfinite(x) for x in values):
                    raise ValueError("scores that are no numbers")
            except MemoryError:
                for i in some:
                    reason[i] = "out_of_memory"
                continue
            except Exception as e:  # noqa: BLE001  whatever a scorer raises
                for i in some:
                    error[i] = f"{type(e).__name__}: {e}"
                continue
            for i, x in zip(some, values, strict=True):
                logit[i] = float(x)
                match[i] = "yes" if x >= threshold + margin else "no" if x < threshold - margin else "uncertain"
        return b.assign(logit=pd.array(logit, "Float64"), operation_match=match, reason=reason, beyond_512=[bool(t > 512) for t in b["input_tokens"]], padded_tokens=pd.array(padded, "Int32"), error=error)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None  # rows whose batch isn't full yet: under batch_size
        for b in frames:
            b = b.reset_index(drop=True) if left is None else pd.concat([left, b], ignore_index=True)
            batches = length_batches([(i, int(t)) for i, t in enumerate(b["input_tokens"]) if t <= max_tokens], batch_size, long)
            last = batches.pop() if batches and len(batches[-1]) < batch_size and b["input_tokens"].iloc[batches[-1][0]] <= long else []
            left = b.iloc[last].reset_index(drop=True) if last else None
            now = b.drop(index=last)
            places = {i: k for k, i in enumerate(now.index)}
            if len(now):
                yield scored(now.reset_index(drop=True), [[places[i] for i in some] for some in batches])
        if left is not None:
            yield scored(left, [list(range(len(left)))])

    return pairs.repartitionByRange("input_tokens", F.xxhash64("text")).sortWithinPartitions("input_tokens").mapInPandas(run, schema)


def padding_waste(scored: DataFrame) -> DataFrame:
    """Pairs, tokens, tokens with padding, and the share of padding, of what was scored."""
    n, padded = F.sum("input_tokens"), F.sum("padded_tokens")
    return scored.where("padded_tokens is not null").agg(F.count("*").alias("pairs"), n.alias("tokens"), padded.alias("padded_tokens"), (1 - n / padded).alias("waste"))


EXTRACTED = "raw string, finished boolean, input_tokens int, error string"


def extract_intents(units: DataFrame, generate: Callable[[str], tuple[str, bool]], count_input: Callable[[str], int], context_tokens: int, max_new_tokens: int = 2048) -> DataFrame:
    """units (with thought) with raw, input_tokens, extraction_status, intents and error.

    count_input: the tokens of a thought's whole input, prompt included; one that leaves no room for max_new_tokens is refused
    before the model runs, not cut. generate: a thought's answer, and whether it came to its end; one without an end is
    generation_truncated. Intents are numbered I1, I2, ... and null unless valid.
    """
    schema = StructType([*units.schema.fields, *StructType.fromDDL(EXTRACTED).fields])

    def run(batches):
        for b in batches:
            rows = []
            for thought in b["thought"]:
                n = 0
                try:
                    n = int(count_input(thought or ""))
                    if n + max_new_tokens > context_tokens:
                        raise ValueError("the input leaves no room for an answer")
                    raw, finished = generate(thought or "")
                    rows.append((raw, bool(finished), n, None))
                except Exception as e:  # noqa: BLE001  whatever a model raises
                    rows.append((None, False, n, f"{type(e).__name__}: {e}"))
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(rows, columns=["raw", "finished", "input_tokens", "error"])], axis=1)

    d = units.mapInPandas(run, schema)
    status = F.when(F.col("error").isNotNull(), F.lit(None)).when(~F.col("finished"), "generation_truncated").otherwise(extraction_status(F.col("raw"), T.text_or_empty(F.col("thought"))))
    d = d.withColumn("extraction_status", status)
    found = F.from_json("raw", "intents array<struct<intent_quote:string,temporal_scope:string>>")["intents"]
    intents = F.transform(found, lambda x, k: F.struct(F.concat(F.lit("I"), (k + 1).cast("string")).alias("intent_id"), x["intent_quote"].alias("intent_quote"), x["temporal_scope"].alias("temporal_scope")))
    return d.withColumn("intents", F.when(F.col("extraction_status") == "valid", intents)).drop("finished")


def run_units(units: DataFrame, generate: Callable[[str], tuple[str, bool]], count_input: Callable[[str], int], scorer: Callable[[list[str]], list[float]], count_tokens: Callable[[str], int], context_tokens: int, max_new_tokens: int = 2048, **scoring) -> DataFrame:
    """Extraction, matching and aggregation of each unit: unit_id, status, step_label, extraction_status, error. A failure is a unit's status.

    units: unit_id, thought, window_complete, actions (array of action_id, model_text).

    Answers that repeat make the written tables small for their rows, so Spark would broadcast whole ones: their joins are told to merge.
    """
    extracted = written(extract_intents(units, generate, count_input, context_tokens, max_new_tokens), "extracted").hint("merge")
    failed = F.coalesce("error", F.when(F.col("extraction_status") != "valid", F.concat(F.lit("invalid extraction: "), "extraction_status")))
    d = extracted.withColumn("failure", failed)
    intents = d.where("failure is null").select("unit_id", F.inline("intents"))
    jobs = candidate_pairs(intents, d.select("unit_id", F.inline("actions"))).withColumn("text", F.concat_ws("\n", "intent_quote", "model_text"))
    counted = F.pandas_udf(lambda texts: texts.map(lambda t: int(count_tokens(t))), "int")
    pairs = written(score_pairs(jobs.select("unit_id", "intent_id", "action_id", "text").withColumn("input_tokens", counted(F.col("text"))), scorer, **scoring), "pairs").hint("merge")
    errors = pairs.groupBy("unit_id").agg(F.min("error").alias("pair_error"))
    facts = d.select("unit_id", "window_complete", F.size("actions").alias("n_actions"))
    labelled = step_labels(intent_results(intents, pairs, facts), facts)
    d = d.join(errors, "unit_id", "left").withColumn("error", F.coalesce("failure", "pair_error")).select("unit_id", "extraction_status", "error")
    out = unit_status(labelled.join(d.hint("merge"), "unit_id"), pairs, F.col("error").isNotNull())
    return out.select("unit_id", "status", F.when(F.col("error").isNotNull(), "uncertain").otherwise(F.col("step_label")).alias("step_label"), "extraction_status", "error")
