"""A training corpus out of ``documents`` in five stages; each is written as Parquet and read again by the next.

1. language_id: documents that language ID rejects (no letter, or a score under the calibrated limit) go.
2. near_duplicates: of each group linked by the n-gram Jaccard join (words by five, 0.8) the document with the smallest id stays; rows that share an id are told apart by their text.
3. decontaminate: documents that hold a benchmark item, verbatim or re-parameterised, go.
4. mix_sources: copies of documents of rare sources, up to the repetition limit; every document stays at least once.
5. token_output: token ids of the mixture in the store's file format, in ascending document order, read back.

Defined cases, of every stage: an empty table gives an empty table with the same columns. Null, empty and letterless texts go in the first stage. A null id is a value like another: the row
is judged by its text and is the last choice of its group. A null language is not learned from, a null source is the source ''. Of rows equal in id and text one stays. Texts of any length are
handled whole. Further columns are kept as they are up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import decontaminate as _decontaminate
from kinfold.llm import jaccard_join, lang_id, mixing, queries, shared, token_store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.fit(docs, learn=~shared.held_out("doc_id", 5, 0))
    return lang_id.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, jaccard_join.JaccardConfig(shingle=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = shared.Scratch(spark, "tokens").path()
    token_store.write_store(docs, path, queries.vocabulary())
    return token_store.read_store(spark, path)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("token_output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    tmp = shared.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        done = tmp.write(stage(spark, docs, sf_dir))
        if i:
            tmp.drop(docs)
        docs = done
    return docs


#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
