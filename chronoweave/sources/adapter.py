"""The driver's tables in the shape of the corpus contracts, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Split contract: train before A, validation before B, test from B on.
TRAIN_END, VALIDATION_END = "2024-01-15", "2024-01-22"

CE = """
 ce0 AS (SELECT event_id, ts AS t, user_id, event_type, value, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events),
 ce AS (SELECT event_id, event_id AS row_ix, t, user_id, CAST(date_trunc('day', t) AS TIMESTAMP) AS day, event_type, value, k,
   'U' || user_id || '-' || (k % 10) AS identity, strftime(t, '%Y-%m-%d') || '/' || k AS vehicle_id, strftime(t, '%Y-%m-%d %H') || '/' || event_type AS co_key,
   CASE user_id % 3 WHEN 0 THEN 'North' WHEN 1 THEN 'South' ELSE 'Coastal' END AS region,
   value > 40 AS secondary, value > 60 AS searched, (event_type IN ('error', 'purchase') AND value > 100) AS seizure,
   (event_type IN ('error', 'purchase') AND value > 100 AND k % 2 = 0) AS arrest, (event_type IN ('view', 'click') AND value > 110) AS hidden,
   t + to_hours(CAST(k % 72 AS INTEGER)) AS label_available,
   CASE WHEN t < TIMESTAMP '2024-01-15' THEN 'train' WHEN t < TIMESTAMP '2024-01-22' THEN 'validation' ELSE 'test' END AS split,
   (event_id * 7919 % 10007) / 10007.0::DOUBLE AS score_a, 0.7::DOUBLE * ((event_id * 6271 % 10009) / 10009.0::DOUBLE) + 0.3::DOUBLE * least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS score_b FROM ce0),
 caught AS (SELECT identity, min(label_available) AS caught_time FROM ce WHERE seizure GROUP BY identity)"""

OBS = """
 first_ship AS (SELECT l_suppkey, min(l_shipdate) AS first_t FROM lineitem GROUP BY l_suppkey),
 obs AS (SELECT 'S' || l_suppkey AS identity, l_orderkey AS event_id, CAST(l_shipdate AS DATE) AS t,
   CASE WHEN l_returnflag = 'R' AND l_discount >= 0.08 THEN l_partkey END AS vehicle_id FROM lineitem),
 house AS (SELECT 'S' || s_suppkey AS identity, s_nationkey % 5 AS household, CAST(first_t AS DATE) AS t FROM supplier JOIN first_ship ON l_suppkey = s_suppkey)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crossing_events(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """The event pool: one row per event, with flags, maturity time, split and two scores.

    With deal, rows move once before anything is derived: a file of few row groups is read by as few tasks.
    """
    raw = table(spark, sf_dir, "events")
    raw = raw.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id") if deal else raw
    e = raw.select("event_id", F.col("ts").cast("timestamp").alias("t"), "user_id", "event_type", "value", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)).alias("k"))
    seizure = F.col("event_type").isin("error", "purchase") & (F.col("value") > 100)
    user = F.col("user_id")
    return e.select(
        "event_id",
        F.col("event_id").alias("row_ix"),
        "t",
        F.date_trunc("DAY", "t").alias("day"),
        "event_type",
        "value",
        "k",
        F.concat(F.lit("U"), user, F.lit("-"), F.col("k") % 10).alias("identity"),
        F.concat(F.date_format("t", "yyyy-MM-dd"), F.lit("/"), F.col("k")).alias("vehicle_id"),
        F.concat(F.date_format("t", "yyyy-MM-dd HH"), F.lit("/"), F.col("event_type")).alias("co_key"),
        F.when(user % 3 == 0, "North").when(user % 3 == 1, "South").otherwise("Coastal").alias("region"),
        (F.col("value") > 40).alias("secondary"),
        (F.col("value") > 60).alias("searched"),
        seizure.alias("seizure"),
        (seizure & (F.col("k") % 2 == 0)).alias("arrest"),
        (F.col("event_type").isin("view", "click") & (F.col("value") > 110)).alias("hidden"),
        F.timestamp_add("HOUR", (F.col("k") % 72).cast("int"), F.col("t")).alias("label_available"),
        F.when(F.col("t") < F.lit(TRAIN_END).cast("timestamp"), "train").when(F.col("t") < F.lit(VALIDATION_END).cast("timestamp"), "validation").otherwise("test").alias("split"),
        ((F.col("event_id") * 7919 % 10007) / F.lit(10007.0)).alias("score_a"),
        (0.7 * ((F.col("event_id") * 6271 % 10009) / F.lit(10009.0)) + 0.3 * F.least(F.col("value") / 200.0, F.lit(1.0))).alias("score_b"),
    )


def observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(observations: identity, event_id, t, vehicle_id), (households: identity, household, t) out of line items and suppliers."""
    items = table(spark, sf_dir, "lineitem")
    hot = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08)
    obs = items.select(F.concat(F.lit("S"), "l_suppkey").alias("identity"), F.col("l_orderkey").alias("event_id"), F.col("l_shipdate").cast("date").alias("t"), F.when(hot, F.col("l_partkey")).alias("vehicle_id"))
    first = items.groupBy("l_suppkey").agg(F.min("l_shipdate").cast("date").alias("t"))
    house = table(spark, sf_dir, "supplier").join(first, F.col("s_suppkey") == F.col("l_suppkey")).select(F.concat(F.lit("S"), "s_suppkey").alias("identity"), (F.col("s_nationkey") % 5).alias("household"), "t")
    return obs, house
