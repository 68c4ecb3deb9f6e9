"""A corpus pipeline of five stages, each one operator of tallyspark.llm applied to all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.bpe import token_digests
from tallyspark.llm.common import Staged, table
from tallyspark.llm.mixing import mixed_rows
from tallyspark.llm.quality import LineRules, pass_quality
from tallyspark.llm.secrets import redact_secrets
from tallyspark.llm.similar import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the line-frequency rule. Copies are the next stage's business: here they
    count as one, as else every copy of a text that a source holds more than 20 times would go."""
    return pass_quality(docs, LineRules(distinct_texts=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    return keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding and decoding", bpe_round_trip),
]

#: SQL cannot express fingerprints by XXH64, the mix or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = Staged(stage(spark, docs, sf_dir), f"stage-{k}").df
    return STAGES[-1][1](spark, docs, sf_dir)
