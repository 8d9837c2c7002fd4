"""Operators on small made inputs, with their edge cases."""

import hashlib
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwright.operators import alignment, audit, curation, inference, selection, skew, steps, trajectory, validation
from loomwright.operators.graph import components


def record(n=10, title="Crash on start", patch="diff --git a/x b/x\n" + "+" * 40, log="l" * 200, target=True, thought="We should look at this because it fails", commands=None):
    commands = commands or (["open a.py", "edit 1:2\nx\nend_of_edit", "pytest"] * n)[:n]
    turns = [m for c in commands for m in (("ai", f"{thought}\n```\n{c}\n```", None), ("user", "seen", None))]
    return ("o__r-1", "swe-agent-llama-70b", target, "submitted", patch, log, [("system", "", "Be brief"), ("user", f"ISSUE:\n{title}\nmore", None), *turns])


SCHEMA = "instance_id string, model_name string, target boolean, exit_status string, generated_patch string, eval_logs string, trajectory array<struct<role:string,text:string,system_prompt:string>>"


def features(spark, *records):
    return trajectory.features(spark.createDataFrame(list(records), SCHEMA))


@pytest.mark.parametrize(
    ("change", "kept"),
    [({}, 1), ({"n": 9}, 0), ({"thought": "x"}, 0), ({"patch": ""}, 0), ({"title": "Add a crash"}, 0), ({"log": "short"}, 0), ({"target": None}, 0), ({"commands": ["open a"] * 10}, 0)],
)
def test_hard_filter(spark, change, kept):
    assert trajectory.eligible(features(spark, record(**change))).count() == kept


def test_score_and_cycles(spark):
    r = trajectory.scored(features(spark, record(n=20))).first()
    assert (r["valid_cycles"], r["ai_turns"], r["phases"]) == (20, 20, ["edit", "inspect", "test"])
    assert r["quality_score"] == pytest.approx(15 + 15 * 10 / 30 + 15 + 10 * 39 / 350 + 16 + 15 + 10, abs=0.01)


def test_cycles_need_an_answer(spark):
    rows = [("ai", "We should look at this because it fails\n```\nls\n```", None)]
    bad = ("a-1", "swe-agent-x-8b", True, "", "", "", rows + rows + [("user", " ", None)] + rows)
    assert features(spark, bad).first()["valid_cycles"] == 0
    assert features(spark, (*bad[:-1], [])).first()["valid_cycles"] == 0


def test_fit_quotas():
    assert selection.fit_quotas({"a": 4, "b": 1}, {"a": 2, "b": 2}, 4) == {"a": 3, "b": 1}
    with pytest.raises(ValueError):
        selection.fit_quotas({"a": 1}, {"a": 2}, 2)


def test_selection_keeps_its_quotas_and_pairs(spark):
    rows = [(f"u{i}", f"i{i // 4}", f"r{i % 3}", "8b" if i % 8 < 4 else "70b", i % 2 == 0, float(i % 7), ("10-19", "20-39", "40+")[i % 3]) for i in range(160)]
    c = spark.createDataFrame(rows, "uid string, instance_id string, repository string, model_short string, target boolean, quality_score double, length_band string")
    q = selection.Quotas({"8b": 3, "70b": 4}, {"8b": 5, "70b": 7})
    got = selection.numbered(selection.select(c, q)).collect()
    again = selection.numbered(selection.select(c.repartition(7, "quality_score"), q)).collect()
    assert sorted(got) == sorted(again)
    assert len({r["uid"] for r in got}) == len(got) == 24
    for m in q.totals:
        for t in (True, False):
            assert sum(r["model_short"] == m and r["target"] == t for r in got) == q.totals[m]
    pairs = {}
    for r in got:
        if r["pair_id"]:
            pairs.setdefault(r["pair_id"], []).append(r)
    assert len(pairs) == 7
    assert all(len(p) == 2 and p[0]["instance_id"] == p[1]["instance_id"] and p[0]["model_short"] == p[1]["model_short"] and p[0]["target"] != p[1]["target"] for p in pairs.values())


def chosen_plainly(rows, q):
    """A selection over all rows, written from its rules: (uid, group) in order of choice."""
    jitter = lambda x: int(hashlib.sha256(f"{q.seed}:{x}".encode()).hexdigest()[:16], 16) / 2**64
    left = {r["uid"]: r for r in rows}
    repository, band, busy, out = Counter(), Counter(), set(), []
    models = [m for _, m in sorted((n, m) for m, n in q.pairs.items())]

    def take(r, group):
        out.append((r["uid"], group))
        band[r["target"], r["length_band"]] += 1
        busy.add((r["model_short"], r["instance_id"]))
        del left[r["uid"]]

    for m in models:
        for _ in range(q.pairs[m]):
            best = None
            for i in {r["instance_id"] for r in rows if r["model_short"] == m}:
                if (m, i) in busy:
                    continue
                sides = [max((r for r in rows if (r["instance_id"], r["model_short"], r["target"]) == (i, m, t)), key=lambda r: (r["quality_score"], jitter(r["uid"])), default=None) for t in (True, False)]
                if None in sides:
                    continue
                g, b = sides
                fixed = g["quality_score"] + b["quality_score"] + 2.0 * (g["length_band"] != b["length_band"]) + jitter(i)
                now = fixed + 3.0 / (1 + band[True, g["length_band"]]) + 3.0 / (1 + band[False, b["length_band"]]) + 2.0 / (1 + repository[g["repository"]])
                key = (repository[g["repository"]] <= 2, now, fixed)
                if best is None or key > best[0]:
                    best = key, g, b
            for r in best[1:]:
                take(r, "paired")
            repository[best[1]["repository"]] += 2
    size = sum(q.totals.values())
    want = {"10-19": round(size * 0.4), "20-39": round(size * 0.4)}
    want["40+"] = size - sum(want.values())
    for t in (True, False):
        for m in models:
            for _ in range(q.totals[m] - q.pairs[m]):
                def key(r):
                    new = (m, r["instance_id"]) not in busy  # noqa: B023
                    short = min(max(want[r["length_band"]] - band[t, r["length_band"]], 0), 8)  # noqa: B023
                    return new and repository[r["repository"]] < 4, new, r["quality_score"] + short * 2.0 + 2.0 / (1 + repository[r["repository"]]) + jitter(r["uid"])

                r = max((r for r in left.values() if r["target"] == t and r["model_short"] == m), key=key)
                take(r, "diversity")
                repository[r["repository"]] += 1
    return out


@pytest.mark.parametrize(("seed", "groups", "depth"), [(k, 48, 4) for k in range(6)] + [(0, 1, 1), (1, 1, 1), (2, 2, 1), (3, 1, 2), (5, 2, 1)])
def test_selection_equals_a_plain_one(spark, monkeypatch, seed, groups, depth):
    """Many or few instances and repositories, tied scores, an instance under several models; with much held at first, or little."""
    monkeypatch.setattr(selection, "GROUPS", groups)
    monkeypatch.setattr(selection, "DEPTH", depth)
    rng = random.Random(seed)
    instances, repositories, rows_of = ((60, 40, 3), (8, 3, 30), (200, 150, 2), (12, 12, 14), (90, 2, 4), (25, 9, 9))[seed]
    rows = []
    for i in range(instances):
        for _ in range(rng.randrange(1, 2 * rows_of)):
            k = len(rows)
            rows.append((f"u{k}", f"i{i}", f"r{i % repositories}", rng.choice(["8b", "8b", "70b", "405b"]), rng.random() < 0.5, float(rng.randrange(60, 90)), rng.choice(["10-19", "20-39", "40+"])))
    names = ["uid", "instance_id", "repository", "model_short", "target", "quality_score", "length_band"]
    c = spark.createDataFrame(rows, "uid string, instance_id string, repository string, model_short string, target boolean, quality_score double, length_band string")
    capacity = {r["model_short"]: r["capacity"] for r in selection.paired_capacity(c).collect()}
    pairs = {m: min(n, capacity[m]) for m, n in {"8b": 6, "70b": 3, "405b": 2}.items()}
    have = Counter((r[3], r[4]) for r in rows)
    q = selection.Quotas(pairs, {m: min(n + 5, have[m, True], have[m, False]) for m, n in pairs.items()})
    got = selection.select(c, q).select("uid", "selection_group").collect()
    assert sorted(map(tuple, got)) == sorted(chosen_plainly([dict(zip(names, r, strict=True)) for r in rows], q))


def test_selection_takes_few_rows_of_many_candidates(spark):
    """As many quotas as in production; equality with a plain choice is tested on smaller tables."""
    i = F.col("id")
    d = spark.range(300_000).select(
        F.concat(F.lit("u"), "id").alias("uid"), F.concat(F.lit("i"), (F.xxhash64(i) % 40_000).cast("string")).alias("instance_id"), F.concat(F.lit("r"), (F.xxhash64(F.xxhash64(i) % 40_000) % 600).cast("string")).alias("repository"),
        F.element_at(F.array(*map(F.lit, ("70b", "8b", "405b"))), (F.pmod(F.hash(i), F.lit(3)) + 1)).alias("model_short"), (F.pmod(F.xxhash64(i, F.lit(1)), F.lit(2)) == 0).alias("target"),
        (F.pmod(F.xxhash64(i, F.lit(2)), F.lit(1000)) / 25.0).alias("quality_score"), F.element_at(F.array(*map(F.lit, ("10-19", "20-39", "40+"))), (F.pmod(F.hash(i, F.lit(3)), F.lit(3)) + 1)).alias("length_band"),
    )
    q = selection.Quotas(selection.PAIR_QUOTAS, selection.TOTAL_QUOTAS)
    got, taken = selection.selected_with_cost(d, q)
    assert taken < 20_000
    rows = Counter((r["model_short"], r["target"]) for r in got.select("model_short", "target").collect())
    assert rows == {(m, t): n for m, n in selection.TOTAL_QUOTAS.items() for t in (True, False)}


def test_contenders_are_bounded_by_quotas(spark):
    d = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("uid"), F.concat(F.lit("i"), (F.col("id") / 2).cast("int").cast("string")).alias("instance_id"), F.concat(F.lit("r"), (F.col("id") / 2).cast("int").cast("string")).alias("repository"),
        F.lit("8b").alias("model_short"), (F.col("id") % 2 == 0).alias("target"), F.rand(3).alias("quality_score"), F.lit("40+").alias("length_band"))
    q = selection.Quotas({"8b": 3}, {"8b": 5})
    assert selection.pair_contenders(selection.pair_options(d), q).count() <= 4 * 3 and selection.diversity_contenders(d, q).count() <= 2 * 11 * 8


def test_summary_of_a_selection(spark):
    rows = [("u1", "i1", "r1", "8b", True, "40+", "paired", 1.0), ("u2", "i1", "r1", "8b", False, "40+", "paired", 2.0), ("u3", "i2", "r1", "70b", False, "10-19", "diversity", 2.5)]
    d = spark.createDataFrame(rows, "uid string, instance_id string, repository string, model_short string, target boolean, length_band string, selection_group string, quality_score double")
    got = selection.summary_json(d, 7, 99)
    assert got["target_counts"] == {"true": 1, "false": 2} and got["model_counts_by_target"] == {"true": {"8b": 1}, "false": {"8b": 1, "70b": 1}}
    assert (got["unique_instance_ids"], got["unique_repositories"], got["quality_score"]) == (2, 1, {"min": 1.0, "max": 2.5, "mean": 1.833})


def test_step_labels(spark):
    intents = spark.createDataFrame([("a", "1", "current"), ("a", "2", "current"), ("b", "1", "current"), ("c", "1", "future"), ("d", "1", "current")], "unit_id string, intent_id string, temporal_scope string")
    pairs = spark.createDataFrame([("a", "1", "x", "yes"), ("a", "2", "x", "no"), ("b", "1", "x", "no"), ("d", "1", "x", "no")], "unit_id string, intent_id string, action_id string, operation_match string")
    units = spark.createDataFrame([("a", True, 1), ("b", True, 1), ("c", True, 1), ("d", False, 1), ("e", True, 0)], "unit_id string, window_complete boolean, n_actions int")
    got = {r["unit_id"]: r["step_label"] for r in alignment.step_labels(alignment.intent_results(intents, pairs, units), units).collect()}
    assert got == {"a": "partially_consistent", "b": "fully_inconsistent", "c": "not_applicable", "d": "uncertain", "e": "not_applicable"}


def test_metrics_of_no_pairs(spark):
    d = spark.createDataFrame([], "unit_id string, intent_quote string, temporal_scope string, action_id string, expected string, actual string")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in alignment.class_metrics(d).collect()}
    assert got == {x: (0.0, None, 0.0) for x in alignment.LABELS}


def test_reconcile_and_duplicates(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,), (3,)], "id long")
    assert sorted(tuple(r) for r in validation.reconcile(a, b, "id").collect()) == [(1, "left"), (3, "right")]
    with pytest.raises(ValueError, match="repeated id: 2"):
        validation.require_unique(b.unionByName(a), "id")
    assert validation.require_unique(a, "id") is a


def snapshot(spark, case=("CASE-0002", "CASE-0002.json"), listed=("CASE-0001", "CASE-0002"), manifest=("CASE-0001", "CASE-0002"), expected=2, **summary):
    cases = spark.createDataFrame([("CASE-0001", "CASE-0001.json", True, "m-8b", "paired"), (*case, False, "m-8b", "paired")], "case_id string, file_name string, target boolean, model_name string, selection_group string")
    told = {"selected_count": 2, "target_counts": {"true": 1, "false": 1}, "model_counts": {"m-8b": 2}, "selection_group_counts": {"paired": 2}} | summary
    ids = lambda x, c: spark.createDataFrame([(i,) for i in x], f"{c} string")
    return validation.snapshot_rules(cases, ids(listed, "case_id"), ids(manifest, "selection_id"), told, expected)


@pytest.mark.parametrize(
    ("change", "broken"),
    [
        ({}, []),
        ({"case": ("CASE-0002", "CASE-2.json")}, ["file names", "case ids equal file names"]),
        ({"case": ("CASE-0001", "CASE-0002.json"), "listed": ["CASE-0001"], "manifest": ["CASE-0001"]}, ["unique case ids", "case ids equal file names", "ids of JSON lines", "ids of the manifest"]),
        ({"listed": ["CASE-0001", "CASE-0001"]}, ["unique ids of JSON lines", "ids of JSON lines"]),
        ({"manifest": ["CASE-0001", "CASE-0003"]}, ["ids of the manifest"]),
        ({"expected": 3, "selected_count": 3}, ["number of files", "ids of JSON lines", "ids of the manifest"]),
        ({"model_counts": {"m-8b": 1}}, ["model_counts as derived"]),
        ({"selected_count": 1}, ["selected_count"]),
    ],
)
def test_snapshot_rules(spark, change, broken):
    rules = snapshot(spark, **change)
    assert [r["rule"] for r in rules.where("not ok").orderBy("position").collect()] == broken
    if broken:
        with pytest.raises(ValueError, match=f"snapshot: {broken[0]}"):
            validation.require_snapshot(rules)
    else:
        validation.require_snapshot(rules)


def test_frozen_counts(spark):
    rules = snapshot(spark, expected=500, selected_count=500)
    assert {"target_counts as frozen", "model_counts as frozen", "selection_group_counts as frozen"} <= {r["rule"] for r in rules.where("not ok").collect()}


def test_samples_must_exist(spark):
    known = spark.createDataFrame([("a",), ("b",)], "case_id string")
    assert validation.require_samples(["b", "a"], known) == ["b", "a"]
    with pytest.raises(ValueError, match="no such sample: c"):
        validation.require_samples(["d", "c"], known)
    with pytest.raises(ValueError, match="repeat"):
        validation.require_samples(["a", "a"], known)


def test_audit(spark):
    rows = [(".env", b"A=1"), ("a/.env.example", b"A=1"), ("x.py", b"API_KEY = 'abc'\nTOKEN = os.environ['T']\n"), ("y.py", b"TOKEN = get()\n"), ("r.md", b"```\nsecret=x\n```\n"), ("q.md", b"```\na\n```\nsecret=x\n"), ("s.yml", b"  db_password: hunter2\n"), ("p.yml", b"token: <secret>\n"), ("m.txt", b"/some/marker/x"), ("m.md", b"/some/marker/x"), ("bin", b"secret=\xff\xfe"), ("logs/a", b""), ("none", None)]
    files = spark.createDataFrame([(p, None if c is None else bytearray(c), len(c or b"")) for p, c in rows], "path string, content binary, bytes long")
    got = [(r["code"], r["path"]) for r in audit.audit(files, "/some/marker/", max_bytes=30).collect()]
    assert got == sorted([("forbidden_path", ".env"), ("forbidden_path", "logs/a"), ("file_too_large", "x.py"), ("machine_absolute_path", "m.txt"), ("possible_secret", "s.yml"), ("possible_secret", "x.py"), ("possible_secret", "q.md")])
    lines = [r["line"] for r in audit.format_issues(audit.audit(files, "/some/marker/", max_bytes=30)).collect()]
    assert "file_too_large: x.py: 40 bytes exceeds 30" in lines


def test_calls_are_tried_again_and_fail_as_a_status(spark):
    slept = []

    def flaky(payload, seen=[]):  # noqa: B006
        seen.append(1)
        if len(seen) < 3:
            raise OSError("down")
        return '{"a": 1}', {"prompt_tokens": 5, "cached": True, "cost": 0.5}

    assert inference.call(flaky, {}, json.loads, 3, slept.append) == ('{"a": 1}', {"prompt_tokens": 5}, 3, None)
    assert len(slept) == 2
    steps = spark.createDataFrame([("a", "p", "think"), ("b", "p", " "), ("c", "q", "think")], "unit_id string, prompt string, thought string")

    def client(payload):
        return ("{}" if payload["messages"][1]["content"] == "p" else "no json"), {"n": 2}

    got = {r["unit_id"]: (r["status"], r["attempts"]) for r in inference.complete(steps, client, json.loads, "m", "s", tries=1).collect()}
    assert got == {"a": ("success", 1), "b": ("skipped_empty", 0), "c": ("error", 1)}


def test_pair_scores(spark):
    pairs = spark.createDataFrame([("a", 5), ("bb", 9000), ("ccc", 700)], "text string, input_tokens int")
    got = {r["text"]: (r["logit"], r["operation_match"], r["reason"], r["beyond_512"], r["error"]) for r in inference.score_pairs(pairs, lambda ts: [len(t) - 2.0 for t in ts]).collect()}
    assert got == {"a": (-1.0, "no", None, False, None), "bb": (None, "uncertain", "context_overflow", True, None), "ccc": (1.0, "yes", None, True, None)}
    assert inference.length_batches([(0, 5), (1, 9000), (2, 3), (3, 4)], 2) == [[2, 3], [0], [1]]


def test_scores_that_are_no_numbers_fail_their_rows_only(spark):
    pairs = spark.createDataFrame([("a", 5000), ("bb", 5000), ("ccc", 5001)], "text string, input_tokens int")  # each alone

    def scorer(ts):
        if ts[0] == "ccc":
            raise MemoryError
        return [float("nan") if ts[0] == "a" else 3.0]

    got = {r["text"]: (r["operation_match"], r["reason"], r["error"]) for r in inference.score_pairs(pairs, scorer).collect()}
    assert got == {"a": ("uncertain", None, "ValueError: scores that are no numbers"), "bb": ("yes", None, None), "ccc": ("uncertain", "out_of_memory", None)}


def test_batches_are_neighbours_in_length(spark):
    """Batches cross the borders of Arrow batches, are full but for a partition's last, and waste little padding."""
    rng = random.Random(3)
    rows = [(k, f"t{k}", rng.choice([rng.randrange(1, 600), rng.randrange(1, 5000), 9000])) for k in range(1500)]
    d = spark.createDataFrame(rows, "k long, text string, input_tokens int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        scored = inference.score_pairs(d, lambda texts: [float(len(texts))] * len(texts), batch_size=8)
        got = scored.withColumn("part", F.spark_partition_id()).collect()
        parts = scored.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r["k"] for r in got) == list(range(1500))
    assert all((r["reason"] == "context_overflow") == (r["input_tokens"] > 8192) == (r["padded_tokens"] is None) for r in got)
    sizes = Counter(r["logit"] for r in got if r["padded_tokens"] is not None and r["input_tokens"] <= 4096)
    assert sum(n for size, n in sizes.items() if size < 8) < 8 * 2 * parts
    assert all(r["logit"] == 1.0 and r["padded_tokens"] == r["input_tokens"] for r in got if 4096 < r["input_tokens"] <= 8192)
    waste = inference.padding_waste(scored).first()
    assert waste["pairs"] == sum(r[2] <= 8192 for r in rows) and waste["waste"] < 0.05


def test_units_run_and_fail_one_by_one(spark):
    rows = [("ok", "open it", True), ("cut", "cut", True), ("bad", "bad", True), ("boom", "boom", True), ("long", "long", True), ("nan", "nan it", True), ("unsure", "maybe it", False), ("none", "nothing", True)]
    units = spark.createDataFrame([(u, t, w, [("A1", "open"), ("A2", "shut")]) for u, t, w in rows], "unit_id string, thought string, window_complete boolean, actions array<struct<action_id:string,model_text:string>>")

    def generate(thought):
        if thought == "boom":
            raise OSError("no device")
        if thought == "nothing":
            return '{"intents": []}', True
        assert thought != "long"  # refused before the model runs
        quote = thought.split()[0]
        return ("junk" if thought == "bad" else json.dumps({"intents": [{"intent_quote": quote, "temporal_scope": "current"}]})), thought != "cut"

    def scorer(texts):
        return [float("nan") if t.startswith("nan") else 0.0 if t.startswith("maybe") else 5.0 if t.split() == ["open", "open"] else -5.0 for t in texts]

    got = {r["unit_id"]: (r["status"], r["step_label"], r["extraction_status"]) for r in inference.run_units(units, generate, lambda t: 5000 if t == "long" else 5, scorer, len, 4096, margin=1.0, batch_size=1).collect()}
    assert got == {
        "ok": ("completed", "fully_consistent", "valid"), "cut": ("technical_failure", "uncertain", "generation_truncated"), "bad": ("technical_failure", "uncertain", "invalid_json"),
        "boom": ("technical_failure", "uncertain", None), "long": ("technical_failure", "uncertain", None), "nan": ("technical_failure", "uncertain", "valid"),
        "unsure": ("completed_with_uncertain", "uncertain", "valid"), "none": ("completed", "not_applicable", "valid"),
    }


def test_units_run_without_tables_in_the_driver(spark):
    """Written tables of repeated answers are small files of many rows; none may be broadcast whole."""
    units = spark.range(40).select(F.col("id").alias("unit_id"), F.lit("open it").alias("thought"), F.lit(True).alias("window_complete"), F.array(F.struct(F.lit("A1").alias("action_id"), F.lit("open").alias("model_text"))).alias("actions"))
    answer = json.dumps({"intents": [{"intent_quote": "open", "temporal_scope": "current"}]})
    got = inference.run_units(units, lambda t: (answer, True), lambda t: 5, lambda texts: [5.0] * len(texts), len, 4096)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["step_label"] for r in got.collect()} == {"fully_consistent"} and got.count() == 40


def test_settings_have_bounds(spark, tmp_path):
    inference.check_bounds(0.0, 0.0, 1, 8192, 1)
    for bad in ((float("nan"), 0, 1, 1, 1), (0, -1, 1, 1, 1), (0, 0, 0, 1, 1), (0, 0, 1, 9000, 1), (0, float("inf"), 1, 1, 1)):
        with pytest.raises(ValueError):
            inference.check_bounds(*bad)
    (tmp_path / "w.bin").write_bytes(b"abc")
    (tmp_path / "sub").mkdir()
    assert {n: f["bytes"] for n, f in inference.folder_fingerprint(str(tmp_path)).items()} == {"w.bin": 3}
    with pytest.raises(ValueError):
        inference.folder_fingerprint(str(tmp_path / "none"))
    units = spark.createDataFrame([("a",), ("b",)], "unit_id string")
    assert inference.require_subset(units.limit(1), units).count() == 1
    for bad in (["a", "a"], ["c"]):
        with pytest.raises(ValueError, match=f"unknown: {bad[0]}"):
            inference.require_subset(spark.createDataFrame([(x,) for x in bad], "unit_id string"), units)


def test_status_follows_pairs_not_intents(spark):
    """An intent with a yes and an uncertain pair is fully consistent, and its unit completed_with_uncertain."""
    intents = spark.createDataFrame([("a", "1", "current"), ("b", "1", "current")], "unit_id string, intent_id string, temporal_scope string")
    pairs = spark.createDataFrame([("a", "1", "x", "yes"), ("a", "1", "y", "uncertain"), ("b", "1", "x", "yes")], "unit_id string, intent_id string, action_id string, operation_match string")
    units = spark.createDataFrame([("a", True, 2), ("b", True, 1), ("c", True, 1)], "unit_id string, window_complete boolean, n_actions int")
    labelled = alignment.step_labels(alignment.intent_results(intents, pairs, units), units)
    got = {r["unit_id"]: (r["step_label"], r["status"]) for r in alignment.unit_status(labelled, pairs, F.col("unit_id") == "c").collect()}
    assert got == {"a": ("fully_consistent", "completed_with_uncertain"), "b": ("fully_consistent", "completed"), "c": ("not_applicable", "technical_failure")}


UNIT = "unit_id string, step_label string, status string, intents array<struct<intent_id:string,intent_quote:string,temporal_scope:string>>, pairs array<struct<intent_id:string,action_id:string,operation_match:string>>"


def test_evaluation(spark):
    intents = [("I1", "open", "current"), ("I2", "later", "future")]
    pairs = [("I1", "A1", "yes"), ("I1", "A2", "no")]
    refs = spark.createDataFrame([(u, "fully_consistent", None, intents, pairs) for u in "abcde"], UNIT)
    preds = spark.createDataFrame([
        ("a", "fully_consistent", "completed", [("X", "open", "current"), ("Y", "later", "future")], [("X", "A1", "yes"), ("X", "A2", "no")]),
        ("b", "uncertain", "completed", [("I1", "other", "current")], [("I1", "A1", "yes")]),
        ("c", "fully_consistent", "technical_failure", intents, pairs),
        ("d", "fully_consistent", None, intents, [("I1", "A1", "no")]),
    ], UNIT)
    cases = alignment.evaluation_cases(refs, preds)
    got = {r["unit_id"]: tuple(r)[1:4] + tuple(r)[6:] for r in cases.collect()}
    assert got == {"a": ("completed", True, True, 2, 2, 0, 0), "b": ("completed", False, False, 2, 0, 2, 1), "c": ("technical_failure", False, False, 2, 0, 2, 0), "d": ("unknown", True, True, 2, 0, 1, 0), "e": ("missing_window", False, False, 2, 0, 2, 0)}
    total = alignment.evaluation_summary(cases).first()
    assert (total["windows"], total["predicted_windows"], total["extraction_exact_rate"], total["step_agreement"], total["pair_agreement"], total["missing_pairs"], total["extra_pairs"]) == (5, 4, 0.4, 0.4, 0.2, 7, 1)
    flat = lambda d: alignment.quoted_pairs(d.select("unit_id", F.inline("intents")), d.select("unit_id", F.inline("pairs")))
    aligned = alignment.align(flat(refs), flat(preds), preds.where("status = 'technical_failure'"))
    by = {r["label"]: (r["support"], r["predicted"], r["hits"]) for r in alignment.class_metrics(aligned).collect()}
    assert by == {"yes": (5, 2, 1), "no": (5, 2, 1), "uncertain": (0, 0, 0)}
    for wrong in ([("z", "x", "completed", [], [])], [("a", "x", "completed", [], [("I9", "A1", "yes")])], [("a", "x", "completed", intents, [("I1", "A1", "yes"), ("I1", "A1", "no")])]):
        with pytest.raises(Exception, match="unknown|repeated"):
            alignment.evaluation_cases(refs, spark.createDataFrame(wrong, UNIT)).collect()


def test_chat_steps(spark):
    """Against a plain version: clipped history of messages and calls, requests, own calls."""
    rng = random.Random(4)
    rows, tasks = [], []
    for c in range(6):
        tasks.append((c, f"task {c}" if c % 2 else None))
        for t in range(rng.randrange(1, 25)):
            calls = [json.dumps({"function": f"f{k}", "args": {"z": k, "a": ["é", None]}}) for k in range(rng.randrange(3))] + ["[1]"] * rng.randrange(2)
            rows.append((c, t, rng.choice(["assistant", "user", "system", None]), rng.choice(["", "  ", "x" * rng.randrange(1, 90), None, "say\nit"]), rng.choice([None, calls])))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tool_calls array<string>")
    want = []
    for c, task in tasks:
        told, k = [], 0
        for _, t, role, text, calls in [r for r in rows if r[0] == c]:
            body = (text or "").strip()
            if role == "assistant":
                k += 1
                before = "\n\n".join(told) or "[No preceding context]"
                want.append((c, k, t, before if len(before) <= 100 else "[Earlier context truncated]\n" + before[-100:], body, calls or [], task or ""))
            if role != "system":
                own = [f"{x['function']}({json.dumps(x['args'], ensure_ascii=False, sort_keys=True)})" for x in map(json.loads, calls or []) if isinstance(x, dict)]
                told.append("\n".join([f"{(role or 'unknown').upper()}: {body or '[empty content]'}", *(["ACTIONS: " + " | ".join(own)] if own else [])]))
    got = steps.assistant_steps(d, context_chars=100, tasks=spark.createDataFrame(tasks, "conv_id long, task string")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_case_steps(spark):
    schema = "case_id string, task string, steps array<struct<step:long,thought:string,action:string,observation:string>>"
    d = spark.createDataFrame([("c", "t", [(None, "a", " ls ", "x"), (7, None, " ", "y"), (9, "b", None, "z")]), ("e", None, []), ("n", "t", None)], schema)
    got = [tuple(r) for r in steps.case_steps(d, 6000).orderBy("source_index").collect()]
    assert [(g[0], g[1], g[2], g[5], g[6]) for g in got] == [("c", 1, 0, "a", ["ls"]), ("c", 7, 1, "", []), ("c", 9, 2, "b", [])]
    assert got[2][4].startswith("THOUGHT None: a\nACTION None: ls\n") and "[empty thought]" in got[2][4] and got[0][4] == "[No preceding context]"


def test_files_and_run_summary(spark):
    d = spark.createDataFrame([("b",), ("a",), ("c",)], "name string")
    assert [r["name"] for r in steps.first_files(d, 2).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="fewer than 4 files"):
        steps.first_files(d, 4).collect()
    s = spark.createDataFrame([("swe", "success", ["i", "j"]), ("swe", None, None), ("kimi", "success", [])], "source_type string, status string, execution_intents array<string>")
    assert {tuple(r) for r in steps.run_summary(s).collect()} == {("swe", "success", 1, 2), ("swe", "unknown", 1, 0), ("kimi", "success", 1, 0)}


@pytest.mark.parametrize(
    ("raw", "told"),
    [('search_dir "class Symbol" hy', '[ACTION] search_dir(query="class Symbol", path="hy")'), ("open hy/models.py", '[ACTION] open(path="hy/models.py")'), ("goto 550", "[ACTION] goto(line=550)"), ("scroll_down", "[ACTION] scroll_down()"),
     ("python a.py -q", '[ACTION] python(command="a.py -q")'), ("rm a", '[ACTION] rm(path="a")'), ("create a", '[ACTION] create(path="a")'), ("ls -la 'b c'", "[ACTION] ls(args=\"-la 'b c'\")"), ("open 'x", None), ("", None), (None, None)],
)
def test_canonical_actions(raw, told):
    assert curation.canonical(raw) == told


def test_verdicts(spark):
    good = {"label": "safe_negative", "negative_type": "t", "confidence": 0.97, "reason": "r", "risk_flags": []}
    rows = [(good, "valid"), (good | {"confidence": 1}, "valid"), (good | {"confidence": 1.5}, "invalid_confidence"), (good | {"label": "x"}, "invalid_label"), (good | {"more": 1}, "invalid_schema"), (good | {"confidence": "0.9"}, "invalid_schema"), ([1], "invalid_schema"), (good | {"risk_flags": None}, "invalid_schema")]
    d = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(rows)] + [(99, "{"), (100, None)], "i long, raw string")
    got = {r["i"]: r["s"] for r in d.select("i", curation.verdict_status(F.col("raw")).alias("s")).collect()}
    assert got == {i: s for i, (_, s) in enumerate(rows)} | {99: "invalid_json", 100: "invalid_json"}
    c = spark.createDataFrame([("a",), ("b",)], "c string").select(curation.judgement_key(F.col("c"), "p", "m", "s").alias("key"), "c")
    done = c.where("c = 'a'").withColumn("status", F.lit("success")).unionByName(c.where("c = 'b'").withColumn("status", F.lit("error")))
    assert [r["c"] for r in curation.unjudged(c, done).collect()] == ["b"]


def test_candidate_audit(spark):
    rows = [("swe", "t1", "success", ["i"], ["ls"]), ("swe", "t1", "success", ["i"], ["edit 1:2"]), ("swe", "t2", "success", ["i"], []), ("swe", "t2", "error", ["i"], ["ls"]), ("kimi", "k", "success", ["i", "j"], ["ls"]), ("kimi", "k", None, None, None)]
    d = spark.createDataFrame(rows, "source string, trajectory_id string, status string, intents array<string>, actions array<string>")
    assert {tuple(r) for r in curation.candidate_audit(d).collect()} == {("swe", 2, 4, 1, 1, 1, 1, True), ("kimi", 1, 2, 0, 0, 0, 2, True)}


def test_groups_join_over_templates_and_splits_do_not_leak(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "z")], "trajectory_id string, template string")
    groups = curation.leak_groups(rows)
    assert {r["trajectory_id"]: r["group_id"] for r in groups.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    chain = spark.createDataFrame([(f"n{i:03d}", f"t{j:03d}") for i in range(60) for j in (i, i + 1)], "trajectory_id string, template string")
    assert {r["group_id"] for r in curation.leak_groups(chain).collect()} == {"n000"}
    alone = spark.createDataFrame([(1, None), (2, None)], "trajectory_id long, template string")
    assert sorted(map(tuple, curation.leak_groups(alone).collect())) == [(1, 1), (2, 2)]
    few = spark.createDataFrame([(f"g{i}",) for i in range(5) for _ in range((60, 10, 14, 8, 8)[i])], "group_id string")
    split = {r["split"]: r["n"] for r in curation.grouped_split(few).groupBy("split").agg(F.sum("rows").alias("n")).collect()}
    assert sum(split.values()) == 100 and split["train"] >= 60 and set(split) == {"train", "validation", "test"}
    assert curation.grouped_split(few.limit(0)).count() == 0
    many = spark.range(2000).select(F.col("id").cast("string").alias("group_id"))
    split = {r["split"]: r["n"] for r in curation.grouped_split(many).groupBy("split").agg(F.sum("rows").alias("n")).collect()}
    assert abs(split["train"] - 1400) <= 1 and abs(split["test"] - 300) <= 1


@pytest.mark.parametrize("bucket", [100_000, 20])
def test_leak_groups_are_a_graph_of_few(spark, monkeypatch, bucket):
    """The graph has the least trajectories of templates only; groups are those of a plain search, a null trajectory joins nothing."""
    monkeypatch.setattr(skew, "BUCKET", bucket)
    rng = random.Random(3)
    rows = [(k, f"t{rng.randrange(80)}") for k in range(150)] + [(k, "all") for k in range(200, 300)] + [(None, "t1"), (None, "t2"), (900, None)]
    rows += [(250, f"s{i}") for i in range(40)] + [(240 - i, f"s{i}") for i in range(40)]
    seen = []
    monkeypatch.setattr(curation, "components", lambda e: (seen.append(e.where("a <> b").count()), components(e))[1])
    got = {r["trajectory_id"]: r["group_id"] for r in curation.leak_groups(spark.createDataFrame(rows, "trajectory_id long, template string")).collect()}
    group = {k: k for k, _ in rows}
    for _ in range(len(rows)):
        least = {}
        for k, t in rows:
            if k is not None and t is not None:
                least[t] = min(least.get(t, group[k]), group[k])
        after = {k: min([group[k], *(least[t] for j, t in rows if j == k and t is not None)]) if k is not None else None for k in group}
        if after == group:
            break
        group = after
    assert got == group and seen[0] < len(set(rows)) / 2


@pytest.mark.parametrize("bucket", [10_000, 25])
def test_hard_negatives_are_all_that_are_valid(spark, monkeypatch, bucket):
    monkeypatch.setattr(skew, "BUCKET", bucket)
    rows = [(f"a{i}", "train", i % 40, "open", "x") for i in range(60)] + [(f"b{i}", "train", i, "open", f"y{i % 2}") for i in range(4)]
    rows += [("c0", "train", 90, "run", "z"), ("c1", "train", 90, "edit", "z"), ("d", "test", 0, "open", "x"), ("e", "test", 1, "run", "q"), ("n", "train", 0, "open", None)]
    rows += [(f"f{i}", "train", 100 + i, f"t{i % 3}", f"u{i % 7}") for i in range(50)]
    d = spark.createDataFrame(rows, "item_id string, split string, trajectory_id long, tool string, target string")
    by_id = {r[0]: r for r in rows}

    def kinds(a, b):
        if a[0] == b[0] or a[1] != b[1] or None in a or None in b or a[3:] == b[3:]:
            return set()
        return {k for k, x in (("same_tool", a[3] == b[3]), ("same_target", a[4] == b[4]), ("same_trajectory", a[2] == b[2])) if x}

    got = {r[0]: [] for r in rows}
    for r in curation.hard_negatives(d).collect():
        got[r["item_id"]].append((r["negative_id"], r["kind"]))
    for a in rows:
        valid = {b[0]: k for b in rows if (k := kinds(a, b))}
        mine = got[a[0]]
        assert len({n for n, _ in mine}) == len(mine) == min(5, len(valid)) and all(k in valid[n] for n, k in mine)
        there = set().union(*valid.values()) - {"same_trajectory"}
        assert there <= {k for _, k in mine}, (by_id[a[0]], mine)


def test_hard_negatives_shuffle_items_not_candidates(spark, monkeypatch):
    """No candidate is a row before the last exchange; values of large keys, found by joins, are those found within rows."""
    d = spark.range(600).select(F.concat(F.lit("i"), "id").alias("item_id"), F.lit("train").alias("split"), (F.col("id") % 90).alias("trajectory_id"), F.when(F.col("id") % 5 > 0, 0).otherwise(F.col("id") % 3).alias("tool"), F.when(F.col("id") % 7 > 0, 0).otherwise(F.col("id") % 40).alias("target"))
    got = curation.hard_negatives(d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("Generate")]
    want = sorted(map(tuple, got.collect()))
    for small in (0, 1000):
        monkeypatch.setattr(curation, "SMALL", small)
        assert sorted(map(tuple, curation.hard_negatives(d).collect())) == want
    twice = curation.hard_negatives(d.union(d.limit(50))).collect()
    assert sorted(map(tuple, twice)) and max(r["rank"] for r in twice) <= 5 and len({(r["item_id"], r["negative_id"]) for r in twice}) == len(twice)


def test_only_texts_with_a_credential_word_are_split(spark):
    texts = ["a\nAPI_Key = x1\nb", "api-key: v\nToKen=y", "no = word", None, "", "password = <secret>", "My_Secret: 'é'\r\nİ token", "apiKEY=z token=w"]
    d = spark.createDataFrame(list(enumerate(texts)), "path long, content string")
    got = audit.secret_lines(d, anchored=False)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "exists(array(lower(content" in plan[plan.index("Generate") :]
    want = [(k, t.index(x)) for k, t in ((k, re.split(audit.LINE_END, t or "")) for k, t in enumerate(texts)) for x in t if (m := re.search(audit.INLINE, x)) and re.search(audit.CREDENTIAL, m[1]) and m[2] not in audit.PLACEHOLDERS]
    assert sorted((r["path"], r["line_no"]) for r in got.collect()) == want and want
    assert [r[0] for r in d.select(audit.may_tell(F.col("content"))).collect()] == [None if t is None else re.search(audit.CREDENTIAL, t) is not None for t in texts]


@pytest.mark.parametrize("part", [1 << 20, 200])
def test_passages_are_whole_in_texts(spark, sf_dir, monkeypatch, part):
    """With one automaton, and with many small parts; empty and repeated passages, and pairs sent on in small batches."""
    monkeypatch.setattr(audit, "PART_CHARS", part)
    words = [f"w{i}" for i in range(14)]
    passages = [(1, " ".join(words)), (2, " ".join(words[:13]) + " other"), (3, "w1 w2 w3"), (4, "w"), (5, "3 w4"), (6, None), (None, " ".join(words[2:])), (8, "a  b c"), (8, "1 w2 w"), (9, ""), (10, "w1 w2 w3"), (10, "w1 w2 w3"), (11, "é☃")]
    texts = [(1, "x" + " ".join(words) + "y"), (2, " ".join(words)), (3, "w1 w2"), (3, "a  b cd"), (None, "say w1 w2 w3"), (4, None), (5, ""), (6, " ".join(words[::-1])), (7, "x é☃é☃"), (7, "x é☃é☃")]
    p, t = spark.createDataFrame(passages, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(audit.passages_within(p, t).collect()) == order((i, d) for i, x in passages for d, y in texts if x is not None and y is not None and x in y)
    if part == 200:
        assert audit.passages_within(p, t.limit(0)).count() == 0
        return
    p, t = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = order((i["item_id"], d["doc_id"]) for i in p.collect() for d in t.collect() if i["text"] in (d["text"] or ""))
    assert want and order(audit.passages_within(p, t.select("doc_id", "text")).collect()) == want
    assert audit.passages_within(p.limit(0), t).count() == 0


@pytest.mark.parametrize("bucket", [100_000, 4])
def test_corruptions_change_one_argument(spark, monkeypatch, bucket):
    """Of random actions with one to three arguments: all that the rules allow where few are, else as many as asked; also with pools dealt out."""
    monkeypatch.setattr(skew, "BUCKET", bucket)
    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), rng.randrange(40), rng.choice(["open", "goto"]), {f: rng.choice(["1", "2", "3.5", "x", "y", "é"]) for f in rng.sample(["line", "path", "q"], rng.randrange(1, 4))}) for k in range(160)] + [(900, None, 1, "open", {"line": "1"}), (901, "a", 1, "open", None), (902, "a", 1, "open", {}), (903, "a", 2, "lone", {"line": "1"})]
    d = spark.createDataFrame(rows, "item_id long, split string, intent long, tool string, arguments map<string,string>")
    got = curation.parameter_corruptions(d).collect()
    number = lambda v: re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", v) is not None
    good = [r for r in rows if r[1] is not None and r[4] is not None]
    by = {}
    for r in got:
        by.setdefault(r["item_id"], []).append(r)
    for i, split, intent, tool, args in good:
        own = {(f, v) for _, s, _, t, a in good if (s, t) == (split, tool) for f, v in a.items() if f in args and v != args[f] and number(v) == number(args[f])}
        own = {(f, v) for f, v in own if not any((s, n, t) == (split, intent, tool) and a == args | {f: v} for _, s, n, t, a in good)}
        mine = sorted(by.get(i, []), key=lambda r: r["rank"])
        assert {(r["field"], r["value"]) for r in mine} <= own and [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert bucket == 4 or len(mine) == min(len(own), curation.PROPOSED)
        assert not own or bucket == 4 or mine
        for r in mine:
            assert r["arguments"] == args | {r["field"]: r["value"]}
            assert r["observed_id"] == min((j for j, s, _, t, a in good if (s, t, a) == (split, tool, r["arguments"])), default=None)
        assert [r["observed_id"] is None for r in mine] == sorted(r["observed_id"] is None for r in mine)
    assert set(by) <= {r[0] for r in good}


def test_corruptions_shuffle_positives_not_candidates(spark, monkeypatch):
    """No candidate is a row before the last exchange; intents of many actions, long lists and hot intents give the same."""
    k = F.col("id")
    d = spark.range(400).select(k.alias("item_id"), (k % 2).alias("split"), F.floor(k / 90).alias("intent"), (k % 3).cast("string").alias("tool"), F.create_map(F.lit("line"), (k * 7 % 31).cast("string"), F.lit("path"), F.concat(F.lit("p"), k % 5)).alias("arguments"))
    rows = lambda got: sorted(repr(r) for r in got.collect())
    monkeypatch.setattr(curation, "TAKEN", 1000)
    got = curation.parameter_corruptions(d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("Generate")]
    want = rows(got)
    for taken, size in ((1, 1 << 20), (8, 0), (1000, 0)):
        monkeypatch.setattr(curation, "TAKEN", taken)
        monkeypatch.setattr(curation, "LIST_BYTES", size)
        assert rows(curation.parameter_corruptions(d)) == want
    twice = curation.parameter_corruptions(d.union(d.limit(20))).collect()
    assert len({(r["item_id"], r["rank"]) for r in twice}) == len(twice) == len(want)


def test_review_is_closed(spark):
    queue = spark.createDataFrame([(1,), (2,)], "item_id long")
    good = spark.createDataFrame([(1, "direct_match"), (2, "no_match")], "item_id long, label string")
    assert [r["item_id"] for r in curation.import_review(queue, good).collect()] == [1]
    for bad in ([(1, "direct_match")], [(1, "direct_match"), (2, "?")], [(1, "direct_match"), (2, "no_match"), (3, "no_match")], [(1, "no_match"), (1, "no_match"), (2, "no_match")]):
        with pytest.raises(Exception, match="review:"):
            curation.import_review(queue, spark.createDataFrame(bad, "item_id long, label string")).collect()
