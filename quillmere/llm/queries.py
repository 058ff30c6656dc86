"""The registered queries of this subpackage: whole tables, production parameters, contract columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import langid, oracles, secrets
from . import quality as quality_network
from .common import arrow_batches, scratch
from .decontam import contamination
from .licenses import license_scan
from .neardup import near_duplicates
from .rules import quality_rules
from .tokens import pack, token_digest, write_tokens
from .toxicity import fit as fit_toxicity
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The word vocabulary of the public tokenizer files, wherever they are installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_digest(write_tokens(docs, scratch(spark, "tokens"), tokenizer_path(), end_id=1, metadata=("lang", "source")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_network.quality(docs, quality_network.fit(docs, _table(spark, sf_dir, "labels")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"), secrets.fit(secrets.default_samples(spark)))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_token_id_output": op1_token_id_output,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_license_scans": op5_license_scans,
    "op6_secret_scans": op6_secret_scans,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLES = {
    "op7_benchmark_decontamination": oracles.OP7,
    "op8_quality_rules": oracles.OP8,
    "op9_minhash_near_dedup": oracles.OP9,
}
