"""Paired bootstrap of found counts, with draws from a hash so that any engine repeats them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rank import value_positions


def resample(pool: DataFrame, replicates: int) -> DataFrame:
    """pool's rows, drawn with replacement: adds rep and slot.  The draw of a slot is the first 32 bits of md5(rep:slot) modulo n."""
    numbered = pool.join(value_positions(pool, "row_ix").select("row_ix", F.col("before").alias("place"), "total"), "row_ix")
    slots = numbered.select(F.col("place").alias("slot"), "total").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "slot").cast("binary")), 1, 8), 16, 10).cast("bigint") % F.col("total")
    return slots.select("rep", "slot", draw.alias("place")).join(numbered.drop("total"), "place")


def paired_differences(sample: DataFrame, a: str, b: str, ks: tuple[int, ...], *within: str) -> DataFrame:
    """rep, k, d: found@k of a minus that of b in each replicate (per day if within has day)."""
    parts = ["rep", *within]

    def rank(score: str):
        return F.row_number().over(W.partitionBy(*parts).orderBy(F.col(score).desc(), "slot"))

    ranked = sample.select("rep", *within, "hidden", rank(a).alias("ra"), rank(b).alias("rb")).where(F.col("hidden") & (F.least("ra", "rb") <= max(ks)))
    long = ranked.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    sums = long.groupBy("rep", "k").agg(F.sum((F.col("ra") <= F.col("k")).cast("long") - (F.col("rb") <= F.col("k")).cast("long")).alias("d"))
    spine = sample.select("rep").distinct().withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return spine.join(sums, ["rep", "k"], "left").select("rep", "k", F.coalesce("d", F.lit(0)).alias("d"))


def difference_summary(differences: DataFrame) -> DataFrame:
    """k, mean_diff, lo, hi (linear percentiles 2.5 and 97.5), p_not_better, significant."""
    d = F.col("d").cast("double")
    out = differences.groupBy("k").agg(F.avg(d).alias("mean_diff"), F.percentile(d, 0.025).alias("lo"), F.percentile(d, 0.975).alias("hi"), F.avg((F.col("d") <= 0).cast("double")).alias("p_not_better"))
    return out.withColumn("significant", F.col("lo") > 0)
