"""Pools, parsing and as-of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import asof
from ..sources.adapter import CE, crossing_events, table
from .registry import query


@query(f"WITH {CE} SELECT c.event_id, c.identity, strftime(c.t, '%Y-%m-%d %H:%M:%S') AS t_text, c.hidden, c.region FROM ce c JOIN ce s ON s.event_id = c.event_id WHERE s.split = 'test'")
def pool_test_inner(spark, sf):
    ce = crossing_events(spark, sf)
    splits = ce.select("event_id", "split")
    pool = ce.drop("split").join(splits.where("split = 'test'"), "event_id")
    return pool.select("event_id", "identity", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("t_text"), "hidden", "region")


@query(f"WITH {CE}, d AS (SELECT event_id, seizure FROM ce WHERE event_id % 7 <> 0) SELECT c.event_id, coalesce(d.seizure, false) AS detected FROM ce c LEFT JOIN d USING (event_id) WHERE c.split = 'train'")
def pool_train_left(spark, sf):
    ce = crossing_events(spark, sf)
    detected = ce.where("event_id % 7 <> 0").select("event_id", "seizure")
    return ce.select("event_id", "split").join(detected, "event_id", "left").where("split = 'train'").select("event_id", F.coalesce("seizure", F.lit(False)).alias("detected"))


@query(f"""WITH {CE}, s AS (SELECT event_id, split FROM ce WHERE event_id % 11 <> 0), e AS (SELECT event_id FROM ce WHERE event_id % 13 <> 0)
 SELECT CASE WHEN e.event_id IS NULL THEN 'right_only' WHEN s.event_id IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n FROM e FULL JOIN s ON e.event_id = s.event_id GROUP BY 1""")
def split_full_outer_audit(spark, sf):
    ce = crossing_events(spark, sf)
    events, splits = ce.where("event_id % 13 <> 0").select(F.col("event_id").alias("e")), ce.where("event_id % 11 <> 0").select(F.col("event_id").alias("s"))
    side = F.when(F.col("e").isNull(), "right_only").when(F.col("s").isNull(), "left_only").otherwise("both")
    return events.join(splits, F.col("e") == F.col("s"), "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CE} SELECT split, count(*) AS n, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_t, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_t, strftime(min(day), '%Y-%m-%d') AS boundary_day FROM ce GROUP BY split")
def split_contract_ranges(spark, sf):
    f = "yyyy-MM-dd HH:mm:ss"
    return crossing_events(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("t"), f).alias("first_t"), F.date_format(F.max("t"), f).alias("last_t"), F.date_format(F.min("day"), "yyyy-MM-dd").alias("boundary_day"))


_TEXTS = "CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'false' WHEN 3 THEN '1' WHEN 4 THEN '' WHEN 5 THEN 'yes' END"


@query(f"""WITH b AS (SELECT {_TEXTS} AS x FROM events) SELECT coalesce(x, '<null>') AS raw, count(*) AS n, bool_or(coalesce(lower(x) = 'true', false)) AS lenient, bool_or(coalesce(length(x) > 0, false)) AS filled,
 bool_or(CASE WHEN lower(trim(x)) = 'true' THEN true WHEN lower(trim(x)) = 'false' THEN false END) AS strict, bool_or(CASE WHEN lower(trim(x)) IN ('true', '1') THEN true WHEN lower(trim(x)) IN ('false', '0') THEN false END) AS token FROM b GROUP BY 1""")
def bool_modes(spark, sf):
    x = F.col("x")
    rows = table(spark, sf, "events").select(F.expr(_TEXTS).alias("x"))
    modes = {"lenient": parse.bool_text, "filled": parse.bool_filled, "strict": parse.bool_strict_or_null, "token": parse.bool_token_or_null}
    return rows.groupBy(F.coalesce(x, F.lit("<null>")).alias("raw")).agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(f(x)).alias(n) for n, f in modes.items()])


_TIMES = "CASE event_id % 5 WHEN 0 THEN {iso} || 'Z' WHEN 1 THEN {iso} WHEN 2 THEN {iso} || '+00:00' WHEN 3 THEN 'not a time' END"


@query(f"""WITH r AS (SELECT event_id % 5 AS kind, ts, {_TIMES.format(iso="strftime(ts, '%Y-%m-%dT%H:%M:%S')")} AS x FROM events)
 SELECT kind, count(*) AS n, count(*) FILTER (x IS NOT NULL AND x <> 'not a time') AS parsed, count(*) FILTER (coalesce(regexp_matches(x, '(Z|[+-][0-9][0-9]:[0-9][0-9])$'), false)) AS aware FROM r GROUP BY kind""")
def time_parse_modes(spark, sf):
    iso = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
    rows = table(spark, sf, "events").select((F.col("event_id") % 5).alias("kind"), F.expr(_TIMES.format(iso=iso)).alias("x"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count(parse.time_lenient(F.col("x"))).alias("parsed"), F.sum(parse.time_is_aware(F.col("x")).cast("long")).alias("aware"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) END AS hour FROM events")
def json_hour_default(spark, sf):
    broken = F.when(F.col("event_id") % 9 == 0, F.lit("{not json")).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", parse.json_number(broken, "$.k").alias("hour"))


@query("SELECT least(11, floor(l_discount * 10 * 12)::INT) AS bin, count(*) AS n FROM lineitem WHERE l_linenumber % 5 <> 0 GROUP BY 1")
def risk_histogram(spark, sf):
    text = F.when(F.col("l_linenumber") % 5 == 0, F.lit("n/a")).otherwise((F.col("l_discount") * 10).cast("string"))
    return table(spark, sf, "lineitem").select(parse.bounded_bin(text).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CE} SELECT event_id, count(*) OVER (PARTITION BY identity ORDER BY epoch_us(t) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_crossings FROM ce")
def asof_prior_counts(spark, sf):
    return asof.prior_counts(crossing_events(spark, sf)).select("event_id", "prior_crossings")


_FLAGS = ("secondary", "seizure", "arrest")


@query(f"""WITH {CE}, f AS (SELECT identity, greatest(t, label_available) AS at, secondary, seizure, arrest FROM ce),
 j AS (SELECT c.event_id, f.secondary, f.seizure, f.arrest FROM ce c LEFT JOIN f ON f.identity = c.identity AND f.at < c.t)
 SELECT event_id, count(*) FILTER (secondary) AS prior_secondary, count(*) FILTER (seizure) AS prior_seizure, count(*) FILTER (arrest) AS prior_arrest FROM j GROUP BY event_id""")
def asof_prior_mature_outcomes(spark, sf):
    return asof.prior_mature(crossing_events(spark, sf), {f: F.col(f) for f in _FLAGS}).select(F.col("row_ix").alias("event_id"), *[f"prior_{f}" for f in _FLAGS])


@query(f"WITH {CE} SELECT identity, strftime(caught_time, '%Y-%m-%d %H:%M:%S') AS caught_text FROM caught")
def caught_times(spark, sf):
    return asof.earliest(crossing_events(spark, sf), F.col("seizure")).select("identity", F.date_format("caught_time", "yyyy-MM-dd HH:mm:ss").alias("caught_text"))


@query(f"WITH {CE} SELECT split, count(*) AS n, count(*) FILTER (seizure AND label_available < TIMESTAMP '2024-01-15') AS positives, count(*) FILTER (seizure AND NOT coalesce(label_available < TIMESTAMP '2024-01-15', false)) AS immature FROM ce GROUP BY split")
def caught_snapshot(spark, sf):
    return asof.caught_snapshot(crossing_events(spark, sf), "2024-01-15", ("split",))


@query(f"WITH {CE} SELECT event_id, seizure AS label FROM ce WHERE t < TIMESTAMP '2024-01-15' AND label_available < TIMESTAMP '2024-01-15'")
def eligible_training(spark, sf):
    return asof.eligible_supervision(crossing_events(spark, sf), "2024-01-15").select("event_id", F.col("seizure").alias("label"))


@query(f"""WITH {CE}, f AS (SELECT identity, greatest(t, label_available) AS at, secondary, seizure, arrest FROM ce),
 j AS (SELECT c.event_id, count(*) FILTER (f.secondary) AS prior_secondary, count(*) FILTER (f.seizure) AS prior_seizure, count(*) FILTER (f.arrest) AS prior_arrest FROM ce c LEFT JOIN f ON f.identity = c.identity AND f.at < c.t GROUP BY 1),
 n AS (SELECT event_id, count(*) OVER (PARTITION BY identity ORDER BY epoch_us(t) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_crossings FROM ce)
 SELECT c.event_id, n.prior_crossings, j.prior_secondary, j.prior_seizure, j.prior_arrest, c.k AS hour, dense_rank() OVER (ORDER BY c.region) - 1 AS region_code, dense_rank() OVER (ORDER BY c.event_type) - 1 AS type_code FROM ce c JOIN j USING (event_id) JOIN n USING (event_id)""")
def baseline_features(spark, sf):
    ce = crossing_events(spark, sf)
    history = asof.prior_counts(ce)
    mature = asof.prior_mature(ce, {f: F.col(f) for f in _FLAGS}).drop("identity")
    rows = history.join(mature, "row_ix")
    rows = asof.encode(asof.encode(rows, ce, "region", "region_code"), ce, "event_type", "type_code")
    return rows.select("event_id", "prior_crossings", *[f"prior_{f}" for f in _FLAGS], F.col("k").alias("hour"), "region_code", "type_code")


@query(f"""WITH {CE}, c AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM (SELECT DISTINCT k AS x FROM ce WHERE split = 'train' AND k % 10 <> 3))
 SELECT event_id, coalesce(code, -1) AS code FROM ce LEFT JOIN c ON c.x = ce.k WHERE split <> 'train'""")
def ordinal_train_only(spark, sf):
    ce = crossing_events(spark, sf)
    return asof.encode(ce.where("split <> 'train'"), ce.where("split = 'train' AND k % 10 <> 3"), "k", "code").select("event_id", "code")


@query(f"WITH {CE} SELECT event_id, strftime(day, '%Y-%m-%d') AS day_text FROM ce LEFT JOIN caught USING (identity) WHERE split = 'test' AND (caught_time IS NULL OR caught_time >= day)")
def official_exclusion(spark, sf):
    ce = crossing_events(spark, sf)
    left = asof.not_caught_before_day(ce.where("split = 'test'"), asof.earliest(ce, F.col("seizure")))
    return left.select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day_text"))


@query("""SELECT o_orderkey AS order_id, same_customer_365d, n_lines AS party_size FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) RANGE BETWEEN 365 * 86400000000 PRECEDING AND 1 PRECEDING) AS same_customer_365d FROM orders) JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def relational_proxies(spark, sf):
    from pyspark.sql import Window as W

    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("party_size"))
    year = W.partitionBy("o_custkey").orderBy("us").rangeBetween(-365 * 86_400_000_000, -1)
    orders = table(spark, sf, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return orders.withColumn("same_customer_365d", F.count(F.lit(1)).over(year)).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("order_id"), "same_customer_365d", "party_size")
