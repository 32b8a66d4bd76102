"""One query an operator, over whole tables with production parameters, and their SQL.

Where training rows are told by a checksum of the id, a row without an id has none: it is scored, is in no
training set, and its held_out is null.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, jaccard, langid, lm, pii, quality, toxicity, warc
from .common import crc_mod, table
from .sql import ORACLES

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def tokenizer(name: str = TOKENIZER) -> tuple[str, str]:
    """(path of a rank file, splitting pattern) of the public tokenizers; QUADRILLE_TOKENIZERS sets their folder."""
    folder = os.environ.get("QUADRILLE_TOKENIZERS")
    if folder and os.path.dirname(folder) not in sys.path:
        sys.path.append(os.path.dirname(folder))
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(crc_mod("doc_id", 3) != 1))
    out = langid.identify(docs, model)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), *tokenizer())


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, p=90)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lm.score_within(docs, crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.filter(crc_mod("doc_id", 4) != 2), table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pii.detect(docs, pii.train(docs)).drop("redacted")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_language_id, op2_quality_rules, op3_decontamination, op4_chat_formatting, op5_warc,
        op6_bpe, op7_jaccard_join, op8_lm_scoring, op9_toxicity, op10_pii,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
