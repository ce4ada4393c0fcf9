"""One query for each corpus operator: the operator over its whole table, with the columns that a
reader can check derived from what the operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlock.llm.oracle import ORACLE_SQL
from airlock.llm.store import small_batches


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlock.llm.topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlock.llm.ngram_join import NgramJoin

    found = NgramJoin(_documents(spark, sf_dir), n=3, percent=90).components()
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlock.llm.language_id import held_out
    from airlock.llm.toxicity import THRESHOLD, score, train

    docs = _documents(spark, sf_dir)
    tested = held_out("doc_id", parts=3, part=1)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~tested)
    return score(docs, model).select("doc_id", tested.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


#: Two turns that hold the template's own control strings.
HARD_CHAT = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlock.llm.chat import format_chats, loss_text, read_back

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = ", ".join(f"({c}L, {t}L, '{r}', r'{x}')" for c, t, r, x in HARD_CHAT)
    chats = format_chats(turns.union(spark.sql(f"SELECT * FROM VALUES {rows}")))
    read = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlock.llm.packing import pack

    pieces = pack(_documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlock.llm.substring_dedup import remove_passages

    kept = remove_passages(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlock.llm.decontamination import find_leaks

    leaks = find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.withColumnRenamed("item", "item_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlock.llm.token_counts import document_token_counts

    return document_token_counts(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlock.llm.language_id import held_out, identify, train

    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlock.llm.suffix_dedup import remove_repeats

    kept = remove_repeats(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlock.llm.collocations import collocations

    return collocations(_documents(spark, sf_dir))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlock.llm.mixing import placed

    mixed = placed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.get("copies", 0)["due"]
    told = mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("passes"), F.coalesce(F.floor(first * 1e6), F.lit(-1)).alias("first_due"))
    return told.orderBy("first_due", "doc_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlock.llm.whitening import whiten

    white = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_chat_format": op4_chat_format,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_collocations": op11_collocations,
    "op12_mixing": op12_mixing,
    "op13_whitening": op13_whitening,
}
