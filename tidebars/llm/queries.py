"""The registered queries of the text operators, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm import bpe, jaccard_join, lexical_scan, merkle, mixing, near_vectors, phrase_index, quality, spotsigs, sql, substring_sort, substring_tree, token_counts, toxicity
from tidebars.llm.textkit import documents, shared_folder


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(parts: int) -> Column:
    """Remainder of the checksum of doc_id as text; a row without doc_id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)), F.lit(0))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = quality.score_documents(documents(spark, sf_dir), labels(spark, sf_dir), "quality", fold(4) != 2)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(documents(spark, sf_dir), labels(spark, sf_dir), "toxic", fold(5) != 0)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "near_ids", "near_cosines")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edits(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir), shared_folder(spark, "mix"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.93)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.component_ids(documents(spark, sf_dir), width=3, percent=90)


def op9_substring_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_tree.remove_repeats(documents(spark, sf_dir))


def op10_substring_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_sort.remove_repeats(documents(spark, sf_dir))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op11_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op12_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_scan.rank(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(documents(spark, sf_dir), tampered, lambda text: text.replace("\n", ""))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_spotsigs": op3_spotsigs,
    "op4_mixing": op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_near_vectors": op7_near_vectors,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_substring_tree": op9_substring_tree,
    "op10_substring_sort": op10_substring_sort,
    "op11_phrase_index": op11_phrase_index,
    "op12_lexical_scan": op12_lexical_scan,
    "op13_merkle": op13_merkle,
}

SQL: dict[str, str] = {
    "op8_jaccard_join": sql.component_ids(width=3, percent=90),
    "op9_substring_tree": sql.removed_words(window=13),
    "op10_substring_sort": sql.removed_bytes(window=200),
    "op11_phrase_index": sql.contaminated(width=10),
    "op12_lexical_scan": sql.ranked(best=20),
    "op13_merkle": sql.manifest(fanout=3),
}
