"""The opN_ queries: each operator over its whole table, with production parameters, as the digest columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.sql import ORACLE  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.packing import CAPACITY, place_pieces, tokenized_pieces, vocabulary, written

    pieces = tokenized_pieces(_read(spark, sf_dir, "documents"), CAPACITY, *vocabulary())
    digests = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    placed = place_pieces(digests, CAPACITY)
    return placed.withColumn("length", F.col("length").cast("long"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.secrets import digest, scan_secrets

    return digest(scan_secrets(_read(spark, sf_dir, "documents"), owner=F.col("source"), repository=F.concat_ws("/", "source", "lang")))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.suffix import remove_repeated_strings

    return remove_repeated_strings(_read(spark, sf_dir, "documents"), length=50).drop("kept")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.html import extract

    return extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.substring import remove_repeated_windows

    return remove_repeated_windows(_read(spark, sf_dir, "documents"), window=13).drop("kept_text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.toxicity import score, train_on

    docs = _read(spark, sf_dir, "documents")
    return score(docs, train_on(docs, _read(spark, sf_dir, "labels")))


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.mixture import WEIGHTS, document_levels, mix_sources

    mixed = mix_sources(_read(spark, sf_dir, "documents"), document_levels(), WEIGHTS, fraction=0.8, epochs=2, seed=17)
    return mixed.select("doc_id", F.element_at("_leaf", 1).alias("domain"), "lang", "source", F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"), F.col("_take").alias("take_tokens"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.ngram_join import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), width=3, percent=90)


def op9_matroska_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.matroska import read_back, store_texts

    return read_back(store_texts(_read(spark, sf_dir, "documents")))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.topk import top_products

    vectors = _read(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.whitening import whiten

    return whiten(_read(spark, sf_dir, "embeddings"), scale=64, shift=1_000_000, components=32)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.trie import numbered_turns, prefix_trie, rebuilt

    turns = numbered_turns(_read(spark, sf_dir, "conversations"))
    return prefix_trie(*rebuilt(turns, base=lambda c: c - c % 5, borrowed=lambda c: F.crc32(c.cast("string")) % 9))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.inverted import build_index, contamination, digest

    return digest(contamination(build_index(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")), width=10))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_secret_scan, op3_suffix_array_dedup, op4_html_extraction, op5_substring_dedup, op6_toxicity, op7_source_mixture, op8_ngram_jaccard_join, op9_matroska_columns, op10_exact_topk, op11_embedding_whitening, op12_conversation_trie, op13_benchmark_decontamination)}
