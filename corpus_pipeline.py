"""From documents to training sequences: five stages, each one corpus operator with its decisions applied.

Every stage reads all that the one before it kept, from Parquet. All but the last return the
columns of `documents`; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlock.llm.decontamination import without_leaks
from airlock.llm.language_id import UNDETERMINED, held_out, identify, train
from airlock.llm.ngram_join import NgramJoin
from airlock.llm.packing import pack
from airlock.llm.store import discard, small_batches, written
from airlock.llm.substring_dedup import without_passages

#: A prediction of at least this probability corrects a document's lang.
CORRECT_FROM = 0.95


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: null and empty texts and texts without a letter go.

    A null lang is filled with the prediction, and one that a prediction of at least CORRECT_FROM
    contradicts is replaced by it, if that has a clear lead. Short and mixed texts, whose language is
    only ambiguous, stay as they are, as do repeated rows and null ids."""
    small_batches(spark)
    letters = docs.where(F.col("text").rlike(r"\p{L}"))
    model = train(letters, ~held_out())
    if model is None:
        return letters
    found = identify(letters, model, prefix="_airlock_").where(F.col("_airlock_lang_pred") != UNDETERMINED)
    sure = (F.col("_airlock_score") >= CORRECT_FROM) & ~F.col("_airlock_ambiguous")
    lang = F.when(F.col("lang").isNull() | sure, F.col("_airlock_lang_pred")).otherwise(F.col("lang"))
    return found.withColumn("lang", lang).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles connect at a similarity of 0.8, the one with the smallest id.

    Texts without words (null, empty) and null ids are linked with nothing and stay. Of repeated rows
    one stays; rows of one id and different texts stand or fall with what they are linked to."""
    small_batches(spark)
    return NgramJoin(docs, n=5, percent=80).first_of_each()


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that a document with a smaller id has; n_chars follows.

    No row goes. Rows of one id take nothing from each other, null ids and texts without words lose
    nothing, and a text that loses nothing stays as it is."""
    small_batches(spark)
    kept = without_passages(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept.columns else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows are judged
    alike, whatever their ids."""
    small_batches(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2048 ids. A null or empty text is one end id; repeated
    rows and null ids are packed each."""
    small_batches(spark)
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over `documents`."""
    docs, source = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if source is not None:
            discard(source)
        source = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenisation and the trained language model can't be expressed in SQL.
ORACLE_SQL = None
