"""A training-data pipeline of five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of
``documents`` for all but the last, which returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import secrets
from quillmere.llm.common import arrow_batches, fresh, written
from quillmere.llm.decontam import decontaminate
from quillmere.llm.neardup import one_of_each
from quillmere.llm.queries import tokenizer_path
from quillmere.llm.tokens import pack
from quillmere.llm.toxicity import fit as fit_toxicity
from quillmere.llm.toxicity import without_toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity models, fitted on these documents and their labels, score below the threshold."""
    arrow_batches(spark)
    return without_toxic(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    A row that repeats an id and a text of a kept row is dropped too; rows of one id with
    different texts are judged apart; rows without an id stay unless they copy a document.
    """
    arrow_batches(spark)
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the table ``benchmark``."""
    arrow_batches(spark)
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew where the text changed."""
    before = fresh(docs, "before")[0]
    clean = secrets.redact(docs, secrets.fit(secrets.default_samples(spark)), before=before)
    return clean.withColumn("n_chars", F.when(F.col(before).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("text").cast("long"))).drop(before)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of at most 4096 tokens."""
    arrow_batches(spark)
    return pack(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: Trained models, similarity groups and tokenizers are not expressible in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
