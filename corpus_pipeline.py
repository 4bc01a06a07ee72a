"""Corpus preparation as stages over ``documents``, each written as Parquet and read again by the next.

The stages keep, in this order, documents whose language is recognised, one of each group of equal texts, one of each group of texts
that hang together by shingle similarity, and those without passages of the benchmark; the last adds token ids and their text.

All stages take null ids, texts and languages, repeated rows, empty tables and further columns of any name: the language stage drops texts
that are null, empty or without letters; the near-copy stage keeps rows with a null id; whole texts are read however long they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import decontamination, exact_dedup, jaccard_join, language_id, queries, sentencepiece_codec
from hirelake.llm.shared import discard, new_path, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the documents with a language; those that the model rejects go."""
    model = language_id.fit(docs)
    return language_id.predict(docs, model).filter("not rejected").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest, then that with the smallest id stays. Null and empty texts are equal."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return jaccard_join.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark within its error budget go; null and empty items are in no document."""
    found = decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("hits") == 0).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decoded; a null or empty text has no ids."""
    both = sentencepiece_codec.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), queries.piece_model())
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language id", identify_language),
    ("exact dedup", drop_copies),
    ("jaccard join", drop_near_copies),
    ("decontamination", decontaminate),
    ("sentencepiece", tokenise),
]

#: SQL has no way to state the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, which stay. What a stage stages, and the results that it read, are deleted once its own are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if i:
            discard(docs)
        docs = spark.read.parquet(path)
    return docs
