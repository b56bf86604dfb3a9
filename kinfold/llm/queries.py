"""The queries of this folder and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import decontaminate, embed_dedup, jaccard_join, lang_id, lm_score, mixing, piece_counts, preference, shared, token_store, toxicity


#: The shingles and the limit of op10.
OP10 = jaccard_join.JaccardConfig(shingle=4, percent=85)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return shared.spread(_table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "lang")
    model = lang_id.fit(docs, learn=~shared.held_out("doc_id", 5, 0))
    return lang_id.identify(docs, model).withColumn("held_out", shared.held_out("doc_id", 5, 0))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.Scratch(spark, "op3").path()
    token_store.write_store(_table(spark, sf_dir, "documents"), path, vocabulary())
    return token_store.read_store(spark, path)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.neighbour_pairs(_table(spark, sf_dir, "conversations")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark")).drop("row_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count_pieces(_documents(spark, sf_dir), vocabulary())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir, "lang"), _table(spark, sf_dir, "labels")
    out = shared.held_out("doc_id", 3, 1)
    langs = lang_id.fit(docs, learn=~out)
    model = toxicity.fit(docs, labels.filter(~out).select("doc_id", "toxic"), langs=langs)
    return toxicity.score(docs, model).withColumn("held_out", out)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents that ``labels`` calls good. The join moves each text once; the scoring pass moves none."""
    docs = _documents(spark, sf_dir)
    good = _table(spark, sf_dir, "labels").filter("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(True))
    model = lm_score.fit(docs.join(good.hint("merge"), "doc_id", "left"), "good")
    return lm_score.score(docs, model)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_documents(spark, sf_dir), OP10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_token_output": op3_token_output,
    "op4_mixing": op4_mixing,
    "op5_chat_format": op5_chat_format,
    "op7_decontamination": op7_decontamination,
    "op6_token_counts": op6_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_jaccard_join": op10_jaccard_join,
}
SQL: dict[str, str] = {
    "op2_embedding_dedup": embed_dedup.sql(),
    "op4_mixing": mixing.sql(),
    "op5_chat_format": preference.SQL,
    "op7_decontamination": decontaminate.sql(),
    "op10_jaccard_join": jaccard_join.sql(OP10),
}
