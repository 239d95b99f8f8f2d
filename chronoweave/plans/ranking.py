"""Ranking, thresholds and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rank import average_percentile, quantile_higher, stable_order
from ..operators import metrics
from ..sources.adapter import CE, crossing_events
from .registry import query

KS, DAILY = (50, 100, 250, 500), (5, 10, 25)
SCORES = ("score_a", "score_b")
_LONG = "l AS (SELECT row_ix, day, hidden, identity, arm, s FROM (SELECT row_ix, day, hidden, identity, 'score_a' AS arm, score_a AS s FROM ce WHERE split = 'test' UNION ALL SELECT row_ix, day, hidden, identity, 'score_b', score_b FROM ce WHERE split = 'test'))"
_TOTAL = "tot AS (SELECT count(*) FILTER (hidden) AS positives, count(DISTINCT day) AS n_days FROM ce WHERE split = 'test')"
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1"


def test_pool(spark, sf):
    return crossing_events(spark, sf).where("split = 'test'")


@query(f"""WITH {CE}, {_LONG}, {_TOTAL}, r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY s DESC, row_ix) AS rk FROM l), ks AS (SELECT unnest([{', '.join(map(str, KS))}])::INT AS k),
 m AS (SELECT arm, k, count(*) FILTER (hidden AND rk <= k) AS found FROM r, ks GROUP BY arm, k), p AS (SELECT arm, k, found, found / k AS precision, CASE WHEN positives > 0 THEN found / positives ELSE 0 END AS recall FROM m, tot) SELECT *, {_F1} FROM p""")
def evaluate_at_k(spark, sf):
    return metrics.found_at(test_pool(spark, sf), SCORES, KS)


@query(f"""WITH {CE}, {_LONG}, {_TOTAL}, r AS (SELECT *, row_number() OVER (PARTITION BY arm, day ORDER BY s DESC, row_ix) AS rk FROM l), ks AS (SELECT unnest([{', '.join(map(str, DAILY))}])::INT AS k),
 m AS (SELECT arm, k, count(*) FILTER (hidden) AS found, count(*) AS budget FROM r, ks WHERE rk <= k GROUP BY arm, k),
 p AS (SELECT arm, k, n_days, found, budget, found / budget AS precision, CASE WHEN positives > 0 THEN found / positives ELSE 0 END AS recall FROM m, tot) SELECT *, {_F1} FROM p""")
def daily_capacity(spark, sf):
    return metrics.daily_capacity(test_pool(spark, sf), SCORES, DAILY)


@query(f"""WITH {CE}, {_LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY arm, day ORDER BY s DESC, row_ix) AS rk FROM l),
 d AS (SELECT arm, day, count(*) FILTER (hidden AND rk <= 10) AS found FROM r GROUP BY arm, day)
 SELECT arm, strftime(day, '%Y-%m-%d') AS day_text, found, sum(found) OVER (PARTITION BY arm ORDER BY day)::BIGINT AS cumulative FROM d""")
def daily_found_cumulative(spark, sf):
    by_day = metrics.daily_ranks(test_pool(spark, sf), SCORES).groupBy("arm", "day").agg(F.sum((F.col("hidden") & (F.col("rk") <= 10)).cast("long")).alias("found"))
    return by_day.select("arm", F.date_format("day", "yyyy-MM-dd").alias("day_text"), "found", F.sum("found").over(W.partitionBy("arm").orderBy("day")).alias("cumulative"))


@query(f"""WITH {CE}, p AS (SELECT *, row_number() OVER (ORDER BY score_b DESC, row_ix) AS rk FROM ce WHERE split = 'test'), ks AS (SELECT unnest([{', '.join(map(str, KS))}])::INT AS k),
 d AS (SELECT region, count(*) FILTER (hidden) AS positives FROM p GROUP BY region), m AS (SELECT region, ks.k, count(*) FILTER (hidden AND rk <= ks.k) AS found FROM p, ks GROUP BY region, ks.k)
 SELECT region, k, found, CASE WHEN positives > 0 THEN found / positives ELSE 0 END AS recall FROM m JOIN d USING (region)""")
def stratum_metrics(spark, sf):
    return metrics.strata_found_at(test_pool(spark, sf), "score_b", "region", KS)


_PCT = "(rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0::DOUBLE) / count(*) OVER ()"


@query(f"WITH {CE}, p AS (SELECT row_ix, floor(score_b * 50) AS s FROM ce) SELECT row_ix, round({_PCT.format(s='s')}, 9) AS percentile FROM p")
def avg_percentile(spark, sf):
    coarse = crossing_events(spark, sf).select("row_ix", F.floor(F.col("score_b") * 50).cast("double").alias("s"))
    return average_percentile(coarse, "s", "percentile").select("row_ix", F.round("percentile", 9).alias("percentile"))


@query(f"WITH {CE}, p AS (SELECT row_ix, {_PCT.format(s='score_a')} AS a, {_PCT.format(s='score_b')} AS b FROM ce WHERE split = 'test') SELECT row_ix, round(0.7 * b + 0.3 * a, 9) AS fused FROM p")
def rank_fuse(spark, sf):
    pool = test_pool(spark, sf).select("row_ix", *SCORES)
    both = average_percentile(average_percentile(pool, "score_a", "a"), "score_b", "b")
    return both.select("row_ix", F.round(0.7 * F.col("b") + 0.3 * F.col("a"), 9).alias("fused"))


@query(f"""WITH {CE}, p AS (SELECT row_ix, hidden, {_PCT.format(s='score_a')} AS a, {_PCT.format(s='score_b')} AS b FROM ce WHERE split = 'validation'), g AS (SELECT *, unnest(range(0, 21)) AS i FROM p),
 r AS (SELECT i, hidden, row_number() OVER (PARTITION BY i ORDER BY (i / 20) * b + (1 - i / 20) * a DESC, row_ix) AS rk FROM g)
 SELECT i / 20 AS w, round((count(*) FILTER (hidden AND rk <= 50) + count(*) FILTER (hidden AND rk <= 100)) / (SELECT count(*) FROM p WHERE hidden) / 2, 9) AS objective FROM r GROUP BY i""")
def weight_grid(spark, sf):
    pool = crossing_events(spark, sf).where("split = 'validation'").select("row_ix", "hidden", *SCORES)
    both = average_percentile(average_percentile(pool, "score_a", "a"), "score_b", "b")
    return metrics.weight_grid(both, "a", "b", (50, 100)).select("w", F.round("objective", 9).alias("objective"))


@query(f"WITH {CE}, r AS (SELECT region, score_b, row_number() OVER (PARTITION BY region ORDER BY score_b) AS rn, count(*) OVER (PARTITION BY region) AS n FROM ce WHERE split = 'train') SELECT region, score_b AS threshold FROM r WHERE rn = ceil(0.95 * (n - 1)) + 1")
def quantile_higher_threshold(spark, sf):
    return quantile_higher(crossing_events(spark, sf).where("split = 'train'"), "score_b", 0.95, ("region",))


@query(f"""WITH {CE}, p AS (SELECT hidden, score_b AS s FROM ce WHERE split = 'validation'), e AS (SELECT min(s) AS lo, max(s) AS hi FROM p), g AS (SELECT unnest(range(0, 100))::INT AS step, lo, hi FROM e),
 t AS (SELECT step, lo + (hi - lo) * step / 99.0::DOUBLE AS threshold FROM g), m AS (SELECT step, any_value(threshold) AS th, count(*) FILTER (s >= threshold) AS selected, count(*) FILTER (s >= threshold AND hidden) AS true_positives FROM t, p GROUP BY step)
 SELECT step, round(th, 9) AS threshold, selected, true_positives, round(CASE WHEN true_positives = 0 THEN 0 ELSE 2 * (true_positives / selected) * (true_positives / (SELECT count(*) FROM p WHERE hidden)) / (true_positives / selected + true_positives / (SELECT count(*) FROM p WHERE hidden)) END, 9) AS f1 FROM m""")
def f1_threshold_sweep(spark, sf):
    out = metrics.threshold_sweep(crossing_events(spark, sf).where("split = 'validation'"), "score_b", "hidden")
    return out.select("step", F.round("threshold", 9).alias("threshold"), "selected", "true_positives", F.round("f1", 9).alias("f1"))


@query(f"""WITH {CE}, p AS (SELECT c.*, CASE WHEN caught_time IS NULL THEN 'never_caught' WHEN caught_time < day THEN 'caught_before' ELSE 'caught_later' END AS stratum FROM ce c LEFT JOIN caught USING (identity) WHERE split = 'test'),
 m AS (SELECT stratum, count(*) AS n, count(*) FILTER (hidden) AS positives, count(*) FILTER (score_b >= 0.65) AS selected, count(*) FILTER (hidden AND score_b >= 0.65) AS true_positives FROM p GROUP BY stratum)
 SELECT *, round(CASE WHEN selected > 0 THEN true_positives / selected ELSE 0 END, 9) AS precision, round(CASE WHEN positives > 0 THEN true_positives / positives ELSE 0 END, 9) AS recall,
  round(CASE WHEN selected > 0 AND positives > 0 THEN (true_positives / selected) / (positives / n) END, 9) AS lift FROM m""")
def frozen_eval_strata(spark, sf):
    from ..operators.asof import earliest

    ce = crossing_events(spark, sf)
    pool = ce.where("split = 'test'").join(earliest(ce, F.col("seizure")), "identity", "left")
    stratum = F.when(F.col("caught_time").isNull(), "never_caught").when(F.col("caught_time") < F.col("day"), "caught_before").otherwise("caught_later")
    out = metrics.binary_metrics(pool.withColumn("stratum", stratum), F.col("score_b") >= 0.65, F.col("hidden"), "stratum")
    return out.select("stratum", "n", "positives", "selected", "true_positives", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "lift")])


@query(f"WITH {CE}, h AS (SELECT * FROM ce WHERE split = 'test' AND hidden AND score_b >= 0.5) SELECT identity, min_by(event_id, (t, event_id::VARCHAR, row_ix)) AS first_event_id, count(*) AS hits FROM h GROUP BY identity")
def first_hits(spark, sf):
    return metrics.first_hits(test_pool(spark, sf).where("hidden AND score_b >= 0.5"))


@query(f"WITH {CE}, p AS (SELECT *, score_b >= 0.6 AS sel FROM ce WHERE split = 'test') SELECT count(DISTINCT CASE WHEN hidden THEN identity END) AS people_missed, count(DISTINCT CASE WHEN hidden AND sel THEN identity END) AS people_found, round(count(DISTINCT CASE WHEN hidden AND sel THEN identity END) / count(DISTINCT CASE WHEN hidden THEN identity END), 9) AS recall FROM p")
def person_recovery(spark, sf):
    return metrics.person_recovery(test_pool(spark, sf), F.col("score_b") >= 0.6, F.col("hidden")).withColumn("recall", F.round("recall", 9))


_SEEDS = "(event_id * {m} % 10007) / 10007.0::DOUBLE"


@query(f"WITH {CE} SELECT event_id, round(({_SEEDS.format(m=7919)} + {_SEEDS.format(m=104729)} + {_SEEDS.format(m=1299709)}) / 3, 9) AS mean_score, 3 AS seeds FROM ce WHERE split = 'test'")
def seed_ensemble(spark, sf):
    seeds = F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), (F.col("event_id") * m % 10007 / F.lit(10007.0)).alias("s")) for i, m in enumerate((7919, 104729, 1299709))])).alias("x")
    return test_pool(spark, sf).select("event_id", seeds).groupBy("event_id").agg(F.round(F.avg("x.s"), 9).alias("mean_score"), F.count(F.lit(1)).cast("int").alias("seeds"))


@query(f"""WITH {CE}, p AS (SELECT row_ix, identity, day, CASE WHEN identity = (SELECT min(identity) FROM ce WHERE split = 'test' AND hidden) THEN score_b * 0.5 ELSE score_b END AS s, score_b FROM ce WHERE split = 'test'),
 q AS (SELECT *, {_PCT.format(s='s')} AS pct, row_number() OVER (PARTITION BY day ORDER BY s DESC, row_ix) AS new_rank, row_number() OVER (PARTITION BY day ORDER BY score_b DESC, row_ix) AS old_rank FROM p)
 SELECT row_ix, round(pct, 9) AS percentile, old_rank, new_rank FROM q WHERE identity = (SELECT min(identity) FROM ce WHERE split = 'test' AND hidden)""")
def frozen_peer_rank(spark, sf):
    pool = test_pool(spark, sf)
    person = F.broadcast(pool.where("hidden").agg(F.min("identity").alias("person")))
    rows = pool.crossJoin(person).withColumn("s", F.when(F.col("identity") == F.col("person"), F.col("score_b") * 0.5).otherwise(F.col("score_b")))
    ranked = average_percentile(rows.select("row_ix", "identity", "person", "day", "s", "score_b"), "s", "percentile")
    for out, score in (("new_rank", "s"), ("old_rank", "score_b")):
        ranked = ranked.withColumn(out, F.row_number().over(W.partitionBy("day").orderBy(*stable_order(score))))
    return ranked.where("identity = person").select("row_ix", F.round("percentile", 9).alias("percentile"), "old_rank", "new_rank")
