"""The corpus pipeline: language ID, near-duplicate removal, decontamination, PII, tokens.

Each stage takes (spark, docs, sf_dir), works on every document its predecessor kept, and returns the
columns of documents; the last returns tokens. run() chains them through Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, decontaminate, jaccard, langid, pii
from quadrille.llm.common import checkpoint, if_small, new_path, table
from quadrille.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language; fill a missing lang with the predicted one."""
    return langid.accepted(docs, langid.train(docs)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of documents linked at five-word similarity 0.8: of its least doc_id, and of the
    texts that stand under this id the one whose set has the least hash. Rows without words are in no group."""
    n = 5
    sets = jaccard.node_sets(docs, n)
    root = jaccard.node_components(docs, sets, n, 80)
    named = sets.filter("node is not null").groupBy("node", "doc_id").agg(F.count("*").alias("rows"))
    named = named.join(root, "node", "left").select("doc_id", "node", "rows", F.coalesce("root", "node").alias("root"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("best"))
    named = named.join(best, "root").withColumn("kept", F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.node") == F.col("node")))
    # an id with one row is decided by the id alone, others (few, and those without an id) by id and text
    ids = checkpoint(named.groupBy("doc_id").agg(F.sum("rows").alias("rows"), F.max("kept").alias("kept")))
    gone = ids.filter("rows = 1 and not kept and doc_id is not null").select("doc_id")
    several = ids.filter("rows > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    kept = docs.join(if_small(gone), "doc_id", "left_anti")
    if several.isEmpty():
        return kept.select(COLUMNS)
    several, same = if_small(several), F.col("doc_id").eqNullSafe(F.col("_id"))
    stay = named.filter("kept").join(several, same, "left_semi").select(F.col("doc_id").alias("_id"), F.col("node").alias("_kept"))
    again = jaccard.with_node(kept.join(several, same, "left_semi"), n)
    once = again.join(if_small(stay), same & (F.col("_node") == F.col("_kept")), "left_semi").dropDuplicates(["doc_id", "_node"])
    single = kept.join(several, same, "left_anti")
    return single.select(COLUMNS).unionByName(once.select(COLUMNS)).unionByName(again.filter("_node is null").select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    leaks = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(if_small(leaks), "doc_id", "left_anti").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in every text."""
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text. Executors still hold what earlier stages made them allocate, so that workers get
    small tables; that changes speed only."""
    return bpe.encode(docs, *tokenizer(), max_states=40_000, max_pieces=50_000).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", tokens),
]

#: Language ID, PII and BPE have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_path(spark, "stage")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
