"""Toxicity by cumulative-link ordinal regression on sparse words.

P(grade <= k) = s(threshold_k - w.x): one weight for each word, shared by all
thresholds, which are kept in order as a first value and positive steps. x
marks which of the model's words a text has; expected severity is the sum over
k of P(grade > k).

Training is on a bounded sample (LABELLED rows, those of least hash of their
id; equal word sets of one grade count once). Grades are labels' own: a column
`grade` (0 for clean, then ever worse), or else `toxic` as grades 0 and 1, with
one threshold; nothing is made up beyond what the labels tell. The model's
words are the FEATURES with the largest chi-square against grade 0. Scoring
covers every document.

Defined results: null and empty texts have no words and score as the base
rate; equal texts score alike; labels of unknown documents and null labels are
ignored; without labels of both kinds nothing is toxic; other columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED = 10_000
FEATURES = 300
#: Rows that must have a word.
LEAST_ROWS = 8
#: Lengths of the beginnings that are features.
STEMS = (4, 5)
PENALTY = 5e-5
WORD = re.compile(r"[^\W\d_]+")
SCORED = "doc_id long, expected_severity double, p_toxic double, grade int, is_toxic boolean"


def words_of(text: str | None) -> set[str]:
    """The words of a text, and the beginnings of longer ones (with a hyphen), so that unseen forms of a stem count too."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {w[:k] + "-" for w in words for k in STEMS if len(w) > k}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold."""
        score = sum(self.weights[w] for w in sorted(words_of(text) & self.weights.keys()))
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - score, -500, 500)))


def fit_ordinal(rows: list[np.ndarray], grade: np.ndarray, features: int, steps: int = 400, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised log loss, by Adam from a fixed start. rows: the features that each row has."""
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, levels = len(rows), int(grade.max())
    share = np.array([np.mean(grade <= k) for k in range(levels)]).clip(1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    value = np.concatenate([np.zeros(features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(value), np.zeros_like(value)
    for t in range(1, steps + 1):
        w, theta = value[:features], np.cumsum(np.concatenate([value[features : features + 1], np.exp(value[features + 1 :])]))
        score = np.bincount(owner, weights=w[flat], minlength=n)
        cum = 1 / (1 + np.exp(np.clip(score[:, None] - theta, -50, 50)))
        edge = np.concatenate([np.zeros((n, 1)), cum, np.ones((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), cum * (1 - cum), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        p = np.maximum(edge[at, grade + 1] - edge[at, grade], 1e-9)
        up, down = slope[at, grade + 1] / p, slope[at, grade] / p
        d_score = (up - down) / n
        d_theta = np.array([np.sum(down[grade == k + 1]) - np.sum(up[grade == k]) for k in range(levels)]) / n
        tail = np.cumsum(d_theta[::-1])[::-1]
        gradient = np.concatenate([np.bincount(flat, weights=d_score[owner], minlength=features) + penalty * w, tail[:1], tail[1:] * np.exp(value[features + 1 :])])
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        value = value - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return value[:features], np.cumsum(np.concatenate([value[features : features + 1], np.exp(value[features + 1 :])]))


def train(vocabulary: list[str], samples: list[tuple[frozenset[str], int]]) -> Model:
    """From the model's words, and rows of (model words, grade)."""
    grade = np.array([g for _, g in samples])
    if not len(grade) or not 0 < np.sum(grade > 0) < len(grade):
        return Model({}, (50.0,))
    samples = sorted(samples, key=lambda s: (sorted(s[0]), s[1]))
    grade = np.array([g for _, g in samples])
    words = sorted(vocabulary)
    number = {w: k for k, w in enumerate(words)}
    present = sorted(set(grade.tolist()))
    rows = [np.array(sorted(number[w] for w in own if w in number), np.int64) for own, _ in samples]
    weights, thresholds = fit_ordinal(rows, np.searchsorted(present, grade), len(words))
    full = []
    for k in range(present[-1]):  # a grade that no row has gets no room
        at = sum(g <= k for g in present)
        full.append(thresholds[at - 1])
    return Model({w: float(x) for w, x in zip(words, weights, strict=True)}, tuple(float(x) for x in full))


def train_on(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, features: int = FEATURES, doc_id: str = "doc_id", text: str = "text") -> Model:
    """labels: doc_id, and grade or toxic. The words are counted and chosen in the cluster; the driver gets each row's model words only."""
    grade = F.col("grade").cast("int") if "grade" in labels.columns else F.col("toxic").cast("int")
    known = labels.where(F.col("doc_id").isNotNull() & grade.isNotNull()).select(F.col("doc_id").alias("_id"), F.greatest(grade, F.lit(0)).alias("_grade"))
    known = known.groupBy("_id").agg(F.max("_grade").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(labelled)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(known), "_id")  # at most `labelled` rows

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_grade"), pa.array([sorted(words_of(t.as_py())) for t in b.column("_text")], pa.list_(pa.string()))], names=["grade", "words"])

    found = rows.mapInArrow(run, "grade int, words array<string>")
    # `labelled` rows at most, kept until the model is there; a part that is lost is made again, with the same rows
    found = found.groupBy(F.sha2(F.concat_ws(" ", "words"), 256).alias("same"), "grade").agg(F.first("words").alias("words")).persist()
    try:
        return _fitted(found, features)
    finally:
        found.unpersist()


def _fitted(found: DataFrame, features: int) -> Model:
    """From rows of grade and words."""
    toxic = F.col("grade") > 0
    sides = {r["toxic"]: r["n"] for r in found.groupBy(toxic.alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n, pos = sum(sides.values()), sides.get(True, 0)
    if not 0 < pos < n:
        return train([], [])
    counts = found.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("have"), F.count_if(toxic).alias("toxic"))
    counts = counts.where(F.col("have") >= min(LEAST_ROWS, max(1, pos // 4)))
    expected = F.col("have") * (pos / n)
    chi = (F.col("toxic") - expected) ** 2 * (1 / expected + 1 / F.greatest(F.col("have") - expected, F.lit(1e-9)))
    vocabulary = [r["word"] for r in counts.orderBy(chi.desc(), "word").limit(features).collect()]
    own = F.array_intersect("words", F.array(*map(F.lit, vocabulary)).cast("array<string>"))
    return train(vocabulary, [(frozenset(r["own"]), r["grade"]) for r in found.select("grade", own.alias("own")).collect()])


def score(docs: DataFrame, model: Model, cut: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Expected severity (0 to the worst grade), P(grade > 0), the likeliest grade and the decision for each document."""

    def run(batches):
        for b in batches:
            above = np.array([model.above(t.as_py()) for t in b.column("_text")]).reshape(-1, len(model.thresholds))
            edge = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            grade = (edge[:, :-1] - edge[:, 1:]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(grade, pa.int32()), pa.array(above[:, 0] >= cut)],
                names=[x.split()[0] for x in SCORED.split(", ")],
            )

    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).mapInArrow(run, SCORED)


def drop_toxic(docs: DataFrame, model: Model, cut: float = 0.5, text: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; all columns stay."""
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(model.above(t)[0] < cut))

    return docs.where(clean(F.coalesce(F.col(text).cast("string"), F.lit(""))))
