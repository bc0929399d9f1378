"""Corpus pipeline: quality classifier, near-duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last returns the encoding of each document left.
Near-duplicates are told by shingles of five words here, where no contract asks for four.

Defined cases: rows with a null text stay as they are but for the classifier, which scores them as the empty text; rows without a doc_id stay in
all stages; repeated rows stay as often as they stand (they share their id, so none is another's copy); empty and very long texts pass
through like others; an empty table gives an empty table; columns besides those of documents go along to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crosspanel.llm import bpe, decontaminate, fm_quality, near_dup, secrets
from crosspanel.llm.common import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier rejects go."""
    return fm_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near-duplicates stays."""
    return near_dup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: benchmark passages go from the texts, and documents that are mostly such passages go."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: secrets are replaced by a mark."""
    return secrets.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document."""
    made = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.drop("decoded")


STAGES = [("quality", good), ("near_dup", distinct), ("decontaminate", decontaminated), ("secrets", without_secrets), ("bpe", encoded)]
#: The classifier and the similarity classes have no SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
