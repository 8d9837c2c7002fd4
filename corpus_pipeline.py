"""A corpus pipeline of five stages; each reads the Parquet that the one before wrote.

Each stage takes (spark, docs, sf_dir). The first four return the columns of
documents: toxicity drops what the model rejects, near duplicates leave the
document of least id of each group, live secrets are replaced in the text, and
the mixture takes whole documents up to each source's budget. The last packs
what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import mixture, ngram_join, packing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model accepts. It is trained on the labelled documents of the stage's input.

    Null and empty texts score as the base rate and stay; null ids are scored, not trained on; equal texts are decided alike;
    whole texts count, however long; without labels of both kinds all rows stay; columns of any name stay; an empty table gives none.
    """
    model = toxicity.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of five-word shingle sets with a similarity of 0.8: that of least id, a null one being the largest.

    Rows are dropped as rows, not by id: repeated rows leave one, and another text of a dropped row's id stays. Null and empty
    texts are no duplicates of anything and stay; columns of any name stay; an empty table gives none.
    """
    return ngram_join.drop_near_duplicates(docs, width=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets of fewer than secrets.WIDE sources replaced in the text.

    A null text stays null, an empty one empty; null sources are one owner; repeated rows and equal texts are redacted alike,
    whole texts whatever their length; columns of any name stay; an empty table gives none.
    """
    return secrets.redact_live(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets take, the one at a cut included; one epoch, so none twice.

    Null and empty texts have no tokens and go; null languages and sources are the label ''; ties of the hash are ordered by id
    and text; repeated rows are rows of their own; columns of any name stay; an empty table gives none.
    """
    return mixture.mix_sources(docs, mixture.document_levels(), mixture.WEIGHTS, fraction=0.9, epochs=1, seed=17, told=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, token ids, sequence_id and offset of each piece.

    Null and empty texts are one token; long ones are cut into pieces; rows of equal or null ids and equal texts are packed each
    for itself; other columns, whatever their names, end here; an empty table gives none.
    """
    pieces = packing.written(packing.tokenized_pieces(docs, packing.CAPACITY, *packing.vocabulary()), "sequences")
    return packing.place_pieces(pieces, packing.CAPACITY)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates), ("secret_scan", redact_secrets), ("source_mixture", mix_sources), ("best_fit_packing", pack)]

#: Trained weights and near duplicates can't be stated in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; a stage's table goes when the next one is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = packing.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            packing.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
