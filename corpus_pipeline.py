"""The corpus pipeline: language ID, quality rules, exact dedup, near-duplicate join, packing.

Each stage takes what its predecessor kept, as (spark, docs, sf_dir) -> DataFrame.  All but the last
return the columns of documents, so that each stage's decisions take effect on the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import exact_dedup, jaccard_groups, packing, ppm, quality
from chronoweave.llm.common import batch_rows, fresh, materialize, text_of
from chronoweave.llm.queries import CAPACITY, tokenizer_path

#: Rows are whole documents here: so many in an Arrow batch, at most, in all stages.  Executors hold batches outside of the heap, workers once more.
ARROW_ROWS = 512


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: texts without a letter, or whose language is not told with a score of 0.5, go."""
    batch_rows(spark, ARROW_ROWS)
    return ppm.keep_identified(docs, ppm.train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: texts that fail the base rules, or diverge from every language, go."""
    batch_rows(spark, ARROW_ROWS)
    return quality.keep_clean(docs, quality.references(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each class of similar documents the one with the smallest doc_id stays.

    Rows without an id, and different texts under one id, are documents of their own: they are ordered by id, null last, then by a
    hash of the text.  Rows that repeat id and text are one document, all of them stay or go.
    """
    batch_rows(spark, ARROW_ROWS)
    awkward = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    key, sha, head = fresh(docs, "row_key", "row_sha", "class_id")
    if awkward.isEmpty():
        rows = docs.withColumn(key, F.col("doc_id"))
    else:
        hashed = docs.withColumn(sha, F.sha2(text_of("text"), 256))
        order = hashed.select("doc_id", F.col(sha).alias("sha")).distinct().orderBy(F.col("doc_id").asc_nulls_last(), "sha")
        keys = materialize(order.select(F.col("doc_id").alias("id"), "sha", F.monotonically_increasing_id().alias(key)), "row_keys")
        joined = hashed.join(keys, hashed["doc_id"].eqNullSafe(keys["id"]) & (hashed[sha] == keys["sha"]))
        rows = materialize(joined.select(*[hashed[f"`{c}`"] for c in docs.columns], keys[key]), "keyed")
    heads = jaccard_groups.jaccard_classes(rows, id_col=key).where("doc_id = component_id").select(F.col("component_id").alias(head)).distinct()
    return rows.join(heads, F.col(key) == F.col(head), "left_semi").drop(key)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: what is left, packed into sequences."""
    batch_rows(spark, ARROW_ROWS)
    return packing.pack_documents(docs, tokenizer_path(), CAPACITY)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("ngram_jaccard", near_copies), ("packing", best_fit)]

#: The language model, the histograms and the packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
