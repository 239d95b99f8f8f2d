"""Ranks over whole tables without a single-task window.

A window without PARTITION BY sends all rows to one task.  These functions rank distinct values instead:
counts by value, cut into ranges by approximate quantiles (a few dozen numbers on the driver, which only
balance the work), summed by range, and accumulated inside each range.  Results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stable_order(score: str, row: str = "row_ix") -> list[Column]:
    """Score descending, NaN last, ties in row order."""
    return [F.isnan(F.col(score)), F.col(score).desc(), F.col(row)]


#: Cuts that are known of a table at most, and rows that a range is meant to hold.
CUTS, RANGE_ROWS = 1024, 500_000


def value_positions(df: DataFrame, value: str, keys: tuple[str, ...] = (), ranges: int = 32) -> DataFrame:
    """keys, value, n (rows of that value), before (rows of smaller values), total (rows).  There are at least ``ranges`` ranges, more for more rows."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    found = df.agg(F.percentile_approx(value, F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]), F.lit(10 * CUTS)), F.count(F.lit(1))).first()
    step = max(1, CUTS // max(ranges, -(-found[1] // RANGE_ROWS)))
    edges = (found[0] or [])[step - 1 :: step]
    cut = F.lit(0) if not edges else F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]), lambda e: e <= F.col(value)))
    placed = counts.withColumn("range_ix", cut)
    by_range = placed.groupBy(*keys, "range_ix").agg(F.sum("n").alias("range_n"))
    w = W.partitionBy(*keys).orderBy("range_ix") if keys else W.partitionBy(F.lit(0)).orderBy("range_ix")
    all_of = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    starts = by_range.select(*keys, "range_ix", F.coalesce(F.sum("range_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("range_n").over(all_of).alias("total"))
    inside = W.partitionBy(*keys, "range_ix").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    joined = placed.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), [*keys, "range_ix"])
    return joined.select(*keys, value, "n", (F.col("start") + F.col("inner")).alias("before"), "total")


def average_percentile(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with out = average rank of the value, divided by the number of rows."""
    places = value_positions(df, value, keys).select(*keys, value, ((F.col("before") + (F.col("n") + 1) / 2) / F.col("total")).alias(out))
    return df.join(places, [*keys, value])


def quantile_higher(df: DataFrame, value: str, q: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, threshold: the value at place ceil(q * (n - 1)), counted from 0."""
    places = value_positions(df, value, keys)
    at = F.ceil(F.lit(q) * (F.col("total") - 1))
    return places.where((F.col("before") <= at) & (F.col("before") + F.col("n") > at)).select(*keys, F.col(value).alias("threshold"))


def top(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows, with rk from 1: each task keeps k rows, only these are merged."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn("rk", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))


def text_positions(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """df with out: the row's place, from 0, in the order of a text and then of a tie column.

    Rows are numbered inside ranges of the text (Spark's range partitioning, written once since its cuts come from a sample), and
    the ranges' sizes are summed: no task sees all rows.
    """
    from ..sources.shared import materialize

    parts = materialize(df.repartitionByRange(F.col(value), F.col(tie)).withColumn("range_ix", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("range_ix").agg(F.count(F.lit(1)).alias("size"))
    before = W.partitionBy(F.lit(0)).orderBy("range_ix").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("range_ix", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("range_ix").orderBy(value, tie)) - 1
    return parts.withColumn("inside", inside).join(F.broadcast(starts), "range_ix").select(*df.columns, (F.col("start") + F.col("inside")).alias(out))
