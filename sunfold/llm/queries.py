"""The queries of this subpackage, each an operator applied to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunfold.llm import alignment, bpe_trie, collocations, exact_dedup, html_blocks, line_dedup, quality, secret_scan, simhash, spm_chunks, syncmers, toxicity
from sunfold.llm.mixing import Mix


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def piece_model() -> str:
    """The public SentencePiece model that queries use; operators take any model's path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_model() -> str:
    """The public byte-level BPE model, likewise."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return spm_chunks.digests(spm_chunks.encode_decode(docs, piece_model()))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source")).taken()


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def ratings_grade() -> F.Column:
    """Grades of the labels table: 0 poor, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality").isNotNull(), 2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_grades(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), ratings_grade(), 3)
    return found.select("doc_id", "held_out", "expected_grade", F.col("tails")[0].alias("at_least_1"), F.col("tails")[1].alias("at_least_2"), "selected")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate_lines(docs)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_read(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_blocks.extract_main_text(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return spm_chunks.digests(bpe_trie.encode_decode(docs, byte_model()))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents").select("doc_id", "text"), byte_model(), piece_model()).drop("text")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_mixing, op3_exact_dedup, op4_syncmers, op5_toxicity, op6_quality, op7_line_dedup, op8_secrets, op9_html, op10_simhash, op11_bpe_trie, op12_alignment, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": line_dedup.SQL, "op13_collocations": collocations.sql()}
