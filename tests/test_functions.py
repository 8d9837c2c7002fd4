"""Text functions against plain Python, on made and on random texts."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, (int, float)) else 'double'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("title", "expected"),
    [("Crash when empty", True), ("Add a flag for the crash", False), ("Report fails", False), ("TypeError in x", True), ("An issue with it", True), ("  ", False), (None, False), ("Refactor", False), ("Nothing here", False), ("it doesnt work", True), ("éfix", False)],
)
def test_bugfix(spark, title, expected):
    assert one(spark, T.is_bugfix(F.col("t")), t=title) is expected


@pytest.mark.parametrize(
    ("action", "expected"),
    [("python run_tests.py", "test"), ("pytest -q", "test"), ("edit 1:2", "edit"), ("x\ncreate a.py", "edit"), ("search_dir foo", "inspect"), ("cat a | grep b", "inspect"), ("python a.py", "run"), ("submit", "other"), (None, "other"), ("openx", "other")],
)
def test_phase(spark, action, expected):
    assert one(spark, T.action_phase(F.col("t")), t=action) == expected


def test_last_block_on_random_texts(spark):
    rng = random.Random(5)
    parts = ["```", "```sh\n", "\n", "ls -a", " ", "a`b", "é", "we should", "\t", "``"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", T.last_block(F.col("t")).alias("b")).collect()
    for r in got:
        found = list(re.finditer(r"(?s)```[^\n`]*\n?(.*?)```", texts[r["i"]]))
        if not found:
            assert r["b"] is None
        else:
            assert (r["b"]["thought"], r["b"]["action"]) == (texts[r["i"]][: found[-1].start()].strip(), found[-1][1].strip())


def test_explicit_thought(spark):
    assert one(spark, T.is_explicit_thought(F.col("t")), t="We should look at this file next")
    assert not one(spark, T.is_explicit_thought(F.col("t")), t="should ok")
    assert not one(spark, T.is_explicit_thought(F.col("t")), t="This long text has no marker at all here")


def test_jitter(spark):
    expected = int.from_bytes(hashlib.sha256(b"7:a:1").digest()[:8], "big") / 2**64
    assert one(spark, T.stable_jitter(F.col("t"), 7), t="a:1") == expected


def test_small_ones(spark):
    assert one(spark, T.repository(F.col("t")), t="o__r-x-12") == "o__r-x"
    assert one(spark, T.model_short(F.col("t")), t="swe-agent-llama-70b") == "70b"
    assert [one(spark, T.length_band(F.lit(n)), t="") for n in (10, 19, 20, 39, 40)] == ["10-19", "10-19", "20-39", "20-39", "40+"]
    assert one(spark, T.issue_title(F.col("t")), t="\n  \n## A title #\nmore") == "A title"
    assert one(spark, T.clip_context(F.col("t"), 3), t="abcdef") == T.TRUNCATED + "def"
    assert one(spark, T.sigmoid(F.col("x")), x=0.0) == 0.5
    assert [one(spark, T.three_way(F.lit(x), 0.0, 1.0), t="") for x in (1.0, 0.9, -1.0, -1.1)] == ["yes", "uncertain", "uncertain", "no"]
    assert one(spark, T.strip(F.col("t")), t="　\x1c a  ") == "a"


def test_parse_object(spark):
    got = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("{\"a\": 1}",), ("[1]",), ("{",), (None,)], "t string").select(F.to_json(T.parse_object(F.col("t"))).alias("j")).collect()
    assert [r["j"] for r in got] == ['{"a":1}', '{"a":1}', None, None, None]


def test_prompt_keeps_braces_of_its_values(spark):
    got = one(spark, T.build_prompt("{thought_step}|{thought}|{preceding_context}", F.lit(3), F.lit(""), F.lit(""), F.col("t")), t="{thought_step}")
    assert got == "3|{thought_step}|" + T.NO_CONTEXT


def test_rounding_is_by_the_exact_binary_value(spark):
    rng = random.Random(8)
    values = [k / 1000 for k in range(-3300, 3300)] + [k / 8 for k in range(400)] + [a / b for a in range(60) for b in range(1, 60)] + [rng.uniform(0, 1000) for _ in range(4000)] + [round(rng.uniform(0, 1e6), 4) + 0.00005 for _ in range(3000)]
    values += [2.675, 1.005, 0.5, 1.5, 2.5, 1e15 + 0.3, 4.5e15 + 0.5, 1e300, -1e300, 5e-324, 0.0, float("inf"), float("-inf"), 0.285, 1.0000005, 0.0000005, 87.3125, None]
    d = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 3, 6):
        got = [r[0] for r in d.select(T.round_exact(F.col("x"), digits)).collect()]
        want = [None if v is None else v if v in (float("inf"), float("-inf")) else round(v, digits) for v in values]
        assert [(v, g) for v, g, w in zip(values, got, want, strict=True) if g != w] == []
    assert math.isnan(spark.createDataFrame([(float("nan"),)], "x double").select(T.round_exact(F.col("x"), 2)).first()[0])
