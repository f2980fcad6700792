"""A training-data pipeline: quality, near duplicates, benchmark leaks, secrets, mixing.

Every stage takes and returns the columns of documents; the last adds how often a document is read. Between stages the
documents are written to the shared folder and read again. Stages take whole texts, however long, and columns of documents
only; of a table without rows they make one without.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, jaccard_join, mixing, quality_knn, secret_crf
from lexloom.llm.common import durable, shared_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. The score is the text's alone, so repeated rows agree; texts
    without words have the sample's mean label as their score and so stay."""
    docs = docs.select(COLUMNS)
    space = quality_knn.learn(docs, table(spark, sf_dir, "labels"))
    return quality_knn.score(docs, space).filter(F.col("score") >= quality_knn.THRESHOLD).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: of those with an id, that of the least id. Of repeated rows of it,
    one stays. Rows without an id take part by their texts, so copies among them go, too."""
    docs = docs.select(COLUMNS)
    found = jaccard_join.jaccard_join(docs)
    keep = durable(found.filter("id = class_key and hash = class_hash").groupBy("id", "hash").agg(F.count("*").alias("n")))
    named = docs.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("hash", F.xxhash64("text"))
    kept = named.join(keep.select("id", "hash"), ["id", "hash"], "left_semi")
    if not keep.filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "hash"])
    return kept.select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    found = decontaminate.leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark, and n_chars to match."""
    docs = docs.select(COLUMNS)
    clean = secret_crf.redact(docs, secret_crf.fit(docs))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with `repeats`: how often. Documents without words are never taken. Rows are
    told apart by id, source and text; of rows that agree in these, as many are taken as often as the mix says."""
    docs = docs.select(COLUMNS)
    keys = ["id", "of", "hash"]
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("source").alias("of")]
    mixed = durable(mixing.mix(docs).filter("taken > 0").select(*key, "hash", (F.col("taken") / F.col("size")).cast("long").alias("repeats")))
    own = docs.select("*", *key, F.xxhash64("text").alias("hash"))
    if not mixed.groupBy(keys).count().filter("count > 1").isEmpty():
        in_order = Window.partitionBy(keys)
        mixed = mixed.withColumn("nth", F.row_number().over(in_order.orderBy(F.desc("repeats"))))
        own = own.withColumn("nth", F.row_number().over(in_order.orderBy("n_chars", "lang")))
        keys = [*keys, "nth"]
    return own.join(mixed, keys).select(*COLUMNS, "repeats")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_knn", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("secret_crf", secret_stage),
    ("mixing", mixing_stage),
]
#: No SQL: the stages train models, search by random hashing and fit budgets. The tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
