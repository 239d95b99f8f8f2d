"""Strict as-of features: evidence counts only if it was available before the moment of scoring.

History is a RANGE frame that ends one microsecond before the row, partitioned by identity; facts that
mature later than they happen are keyed by the later of both times and united with the probes, so
there is no join at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialize


def prior_counts(events: DataFrame, identity: str = "identity", at: str = "t") -> DataFrame:
    """events with prior_crossings: own events strictly before."""
    before = W.partitionBy(identity).orderBy(F.unix_micros(at)).rangeBetween(W.unboundedPreceding, -1)
    return events.withColumn("prior_crossings", F.count(F.lit(1)).over(before))


def prior_mature(events: DataFrame, flags: dict[str, Column], identity: str = "identity", at: str = "t", label: str = "label_available", row: str = "row_ix") -> DataFrame:
    """row, identity, and for each flag how many own events had it, happened and matured strictly before."""
    later = F.when(F.col(at).isNotNull() & F.col(label).isNotNull(), F.greatest(at, label))
    facts = events.select(F.lit(None).cast("bigint").alias(row), identity, F.unix_micros(later).alias("us"), *[f.cast("long").alias(n) for n, f in flags.items()]).where(F.col("us").isNotNull())
    facts = facts.where(" OR ".join(f"{n} = 1" for n in flags))
    probes = events.select(row, identity, F.unix_micros(at).alias("us"), *[F.lit(0).cast("long").alias(n) for n in flags])
    before = W.partitionBy(identity).orderBy("us").rangeBetween(W.unboundedPreceding, -1)
    both = facts.unionByName(probes)
    return both.select(row, identity, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"prior_{n}") for n in flags]).where(F.col(row).isNotNull())


def earliest(rows: DataFrame, when: Column, identity: str = "identity", time: str = "label_available", out: str = "caught_time") -> DataFrame:
    """identity, earliest time of rows for which `when` holds; null times never count."""
    return rows.where(when & F.col(time).isNotNull() & F.col(identity).isNotNull()).groupBy(identity).agg(F.min(time).alias(out))


def not_caught_before_day(pool: DataFrame, caught: DataFrame, identity: str = "identity", day: str = "day") -> DataFrame:
    """Rows whose identity was not caught strictly before the start of the day."""
    return pool.join(caught, identity, "left").where(F.col("caught_time").isNull() | (F.col("caught_time") >= F.col(day)))


#: Categories that are numbered on the driver, at most; beyond, each range of values is numbered in a task of its own.
FEW_CATEGORIES = 100_000


def category_codes(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct non-null values with their place in their order, from 0."""
    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    first = values.limit(FEW_CATEGORIES + 1).collect()
    if len(first) <= FEW_CATEGORIES:
        numbered = [(v, i) for i, v in enumerate(sorted(r[0] for r in first))]
        return F.broadcast(values.sparkSession.createDataFrame(numbered, T.StructType([values.schema[0], T.StructField(out, T.IntegerType())])))
    parts = materialize(values.repartitionByRange(column).withColumn("part", F.spark_partition_id()), "categories")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(column)) - 1
    return parts.withColumn("inside", inside).join(F.broadcast(starts), "part").select(column, (F.col("start") + F.col("inside")).cast("int").alias(out))


def encode(rows: DataFrame, fitted_on: DataFrame, column: str, out: str) -> DataFrame:
    """Code by the categories of fitted_on; unseen and null are -1."""
    codes = category_codes(fitted_on, column, out)
    return rows.join(codes, column, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def encode_many(rows: DataFrame, fitted_on: DataFrame, columns: dict[str, str], nulls_raise: bool = False) -> DataFrame:
    """Codes (column -> name of the code) by the categories of fitted_on, all collected in one job; unseen is -1, null too unless it raises.

    Categories beyond FEW_CATEGORIES a column are numbered column by column.
    """
    if nulls_raise:
        for column in columns:
            error = F.raise_error(F.lit(f"missing categorical value in {column}"))
            rows = rows.withColumn(column, F.coalesce(F.col(column), error.cast(rows.schema[column].dataType)))
            fitted_on = fitted_on.withColumn(column, F.coalesce(F.col(column), error.cast(fitted_on.schema[column].dataType)))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    found = fitted_on.select(cells).select("x.*").where("value IS NOT NULL").distinct().limit(FEW_CATEGORIES + 1).collect()
    if len(found) > FEW_CATEGORIES or any(not isinstance(fitted_on.schema[c].dataType, T.StringType) for c in columns):
        for column, out in columns.items():
            rows = encode(rows, fitted_on, column, out)
        return rows
    spark = rows.sparkSession
    for column, out in columns.items():
        values = sorted(r["value"] for r in found if r["column"] == column)
        codes = spark.createDataFrame([(v, i) for i, v in enumerate(values)], T.StructType([T.StructField(column, T.StringType()), T.StructField(out, T.IntegerType())]))
        rows = rows.join(F.broadcast(codes), column, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))
    return rows


def caught_snapshot(rows: DataFrame, cutoff: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, positives (seized, label before the cutoff), immature (seized, label not yet)."""
    mature = F.coalesce(F.col("label_available") < F.lit(cutoff).cast("timestamp"), F.lit(False))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("seizure") & mature).cast("long")).alias("positives"), F.sum((F.col("seizure") & ~mature).cast("long")).alias("immature"))


def eligible_supervision(rows: DataFrame, cutoff: str) -> DataFrame:
    """Rows that happened and matured strictly before the cutoff."""
    c = F.lit(cutoff).cast("timestamp")
    return rows.where((F.col("t") < c) & (F.col("label_available") < c))


def training_rows(train: DataFrame, mode: str, positive: str = "true_contraband_present") -> tuple[DataFrame, DataFrame]:
    """(rows to fit on, one row with train_positive_excluded): all rows in strict mode, rows not known to be positive in assisted mode."""
    known = F.coalesce(F.col(positive), F.lit(False))
    if mode == "strict":
        return train, train.sparkSession.range(1).select(F.lit(0).cast("long").alias("train_positive_excluded"))
    if mode == "assisted":
        return train.where(~known), train.agg(F.count_if(known).alias("train_positive_excluded"))
    raise ValueError(f"unknown anomaly mode: {mode!r}")
