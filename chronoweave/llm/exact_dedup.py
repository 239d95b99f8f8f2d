"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

The comparison of bytes is the grouping itself.  Texts are aggregated on (128-bit hash, whole
normalised text), so Spark's hash aggregate compares the bytes of every text with those of its
group, and map tasks send one row for each distinct text they hold, however many copies there are.
Two different texts under one hash come out as two groups; a SHA-256 of the text tells them apart
when ids are joined back, and should even that pair collide, the query raises instead of merging.

Defined results
    null text       counts as the empty text
    empty table     gives an empty table
    ties            rows that repeat id and text are one document written several times: all count
                    in group_size, one of them stays
    null id         sorts after every other id; it is kept only where the whole group has no id
    equal ids with different texts are different documents
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, col, fresh, text_of


def normalised(text_col: str):
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(text_of(text_col), WHITE_SPACE, " ")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: h (binary 128 bits), sha (hex), keep_id, group_size."""
    rows = df.select(col(id_col).alias("id"), normalised(text_col).alias("norm"))
    by_bytes = rows.groupBy(F.unhex(F.md5("norm")).alias("h"), "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    keyed = by_bytes.select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
    once = keyed.groupBy("h", "sha").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    clash = F.raise_error(F.lit("two texts share both of their hashes")).cast("long")
    return once.select("h", "sha", "keep_id", F.when(F.col("texts") > 1, clash).otherwise(F.col("group_size")).alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Only ids and hashes travel to be joined; a hot group of copies is one row on the group side,
    and the side with its ids is an ordinary skewed join that adaptive execution splits.
    """
    rows = df.select(col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    keys = rows.select("doc_id", F.unhex(F.md5("norm")).alias("h"), F.sha2("norm", 256).alias("sha"))
    written = keys.groupBy("doc_id", "h", "sha").agg(F.count(F.lit(1)).alias("times"))
    joined = written.join(exact_groups(df, id_col, text_col), ["h", "sha"])
    each = joined.select("doc_id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns: one for each distinct normalised text."""
    key_id, key_sha = fresh(df, "keep_key_id", "keep_key_sha")
    stay = exact_groups(df, id_col, text_col).select(F.col("keep_id").alias(key_id), F.col("sha").alias(key_sha))
    mine = fresh(df, "keep_key_id", "keep_key_sha", "own_sha")[2]
    rows = df.withColumn(mine, F.sha2(normalised(text_col), 256))
    hit = rows.join(stay, col(id_col).eqNullSafe(F.col(key_id)) & (F.col(mine) == F.col(key_sha)), "left_semi")
    return hit.dropDuplicates([id_col, mine]).select(*[col(c) for c in df.columns])
