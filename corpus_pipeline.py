"""From raw documents to training tokens: five stages, each a whole pass over what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunfold.llm import line_dedup, simhash, spm_chunks, toxicity
from sunfold.llm.mixing import Mix
from sunfold.llm.queries import piece_model
from sunfold.runtime import drop_path, scratch_path


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def _all(docs: DataFrame) -> list[str]:
    """The columns of docs, in quotes."""
    return [f"`{c}`" for c in docs.columns]


def _new(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = tuple(_new(docs, n) for n in ("held_out", "score", "predicted"))
    found = toxicity.toxicity_scores(docs, labels, carry=tuple(docs.columns), names=names)
    return found.filter(F.col(f"`{names[2]}`") == 0).select(_all(docs))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats; no document goes. One whose every line repeats is a copy among
    many and keeps its text, for the next stage to judge."""
    freed = line_dedup.drop_boilerplate_lines(docs, keep_copies=True, dropped=_new(docs, "lines_dropped"))
    return _counted(freed.select(_all(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each_cluster(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a row for each pass over a document, with the words that the mix takes."""
    return _counted(Mix(docs).documents())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and the text that they decode to."""
    found = spm_chunks.encode_decode(docs, piece_model(), block_mb=6)
    return found.select("doc_id", "lang", "source", F.col("decoded").alias("text"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL expresses neither the model of the first stage nor the stages after the second.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again as the next one's input; what a stage read is deleted once
    its result is written.

    Null and empty texts pass the first three stages, where they are near-duplicates of each other, and have no words for the
    mix to take. Rows without a doc_id pass, each for itself. Of rows with one doc_id one stays at the third stage. Other
    columns are carried to the mix, whatever their names. No documents give no rows."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
