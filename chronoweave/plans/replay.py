"""Replay, resampling and evidence."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parse import ordered_hash
from ..functions.rank import average_percentile, value_positions
from ..operators import bootstrap, simulate
from ..operators.asof import earliest
from ..sources.adapter import CE, crossing_events
from .ranking import SCORES, _PCT
from .registry import query

BUDGETS = (5, 10)


def _replay_sql(arms: dict[str, str], ks: tuple[int, ...]) -> str:
    """Days as steps of a recursion: what a step carries is who was found before, and what it took."""
    long = " UNION ALL ".join(f"SELECT '{arm}' AS arm, day, row_ix, event_id, identity, hidden, {score} AS s FROM ok" for arm, score in arms.items())
    return f"""WITH RECURSIVE {CE}, ok AS (SELECT c.* FROM ce c LEFT JOIN caught USING (identity) WHERE split = 'test' AND (caught_time IS NULL OR caught_time >= day)),
 l AS ({long}), days AS (SELECT day, row_number() OVER (ORDER BY day) AS step FROM (SELECT DISTINCT day FROM ok)),
 lists AS (SELECT arm, step, day, list(struct_pack(row_ix := row_ix, event_id := event_id, identity := identity, hidden := hidden) ORDER BY s DESC, row_ix) AS rows_ FROM l JOIN days USING (day) GROUP BY ALL),
 r(arm, k, step, day, gone, picks) AS (
  SELECT arm, k, 0::BIGINT, NULL::TIMESTAMP, []::VARCHAR[], []::STRUCT(row_ix BIGINT, event_id BIGINT, identity VARCHAR, hidden BOOLEAN)[] FROM (SELECT DISTINCT arm FROM l), (SELECT unnest([{', '.join(map(str, ks))}])::INT AS k)
  UNION ALL SELECT arm, k, step, day, list_concat(gone, list_distinct(list_transform(list_filter(picks, lambda x: x.hidden), lambda x: x.identity))), picks FROM (
   SELECT r.arm, r.k, lists.step, lists.day, r.gone, list_filter(lists.rows_, lambda x: NOT list_contains(r.gone, x.identity))[1:r.k] AS picks FROM r JOIN lists ON lists.arm = r.arm AND lists.step = r.step + 1)),
 seen AS (SELECT arm, k, day, generate_subscripts(picks, 1) AS inspected_rank, unnest(picks) AS x FROM r WHERE step > 0),
 found AS (SELECT arm, k, x.identity AS identity, min(day) AS found_day FROM seen WHERE x.hidden GROUP BY 1, 2, 3)"""


def _replay(spark, sf):
    ce = crossing_events(spark, sf)
    return simulate.replay(ce.where("split = 'test'"), earliest(ce, F.col("seizure")), SCORES, BUDGETS)


_ARMS = {a: a for a in SCORES}


@query(f"""{_replay_sql(_ARMS, BUDGETS)}, b AS (SELECT arm, k, count(*) AS budget FROM seen GROUP BY 1, 2), p AS (SELECT arm, k, count(*) AS people_found FROM found GROUP BY 1, 2), t AS (SELECT count(DISTINCT identity) AS people FROM ok WHERE hidden),
 g AS (SELECT f.arm, f.k, count(*) AS candidates_removed, count(*) FILTER (ok.hidden) AS hidden_removed FROM found f JOIN ok ON ok.identity = f.identity AND ok.day > f.found_day GROUP BY 1, 2),
 m AS (SELECT arm, k, budget, coalesce(people_found, 0) AS people_found, coalesce(candidates_removed, 0) AS candidates_removed, coalesce(hidden_removed, 0) AS hidden_removed, people FROM b LEFT JOIN p USING (arm, k) LEFT JOIN g USING (arm, k), t),
 q AS (SELECT *, people_found / budget AS precision, CASE WHEN people > 0 THEN people_found / people ELSE 0 END AS recall FROM m)
 SELECT arm, k, budget, people_found, candidates_removed, hidden_removed, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM q""")
def simulated_catches(spark, sf):
    return simulate.summary(*_replay(spark, sf))


@query(f"{_replay_sql(_ARMS, BUDGETS)}, h AS (SELECT arm, k, x.identity AS identity, min((day, inspected_rank, x.event_id)) AS a FROM seen WHERE x.hidden GROUP BY 1, 2, 3) SELECT arm, k, identity, strftime(a[1], '%Y-%m-%d') AS day_text, a[3] AS event_id, a[2] AS inspected_rank FROM h")
def recovery_anchors(spark, sf):
    rows = simulate.anchors(_replay(spark, sf)[0])
    return rows.select("arm", "k", "identity", F.date_format("day", "yyyy-MM-dd").alias("day_text"), "event_id", "inspected_rank")


@query(f"{_replay_sql(_ARMS, BUDGETS)}, w AS (SELECT k, identity, count(*) AS n, min(arm) AS arm FROM found GROUP BY 1, 2) SELECT k, CASE WHEN n = 2 THEN 'both' WHEN arm = '{SCORES[0]}' THEN 'baseline_only' ELSE 'other_only' END AS side, count(*) AS people FROM w GROUP BY 1, 2")
def recovery_overlap(spark, sf):
    return simulate.overlap(_replay(spark, sf)[1], *SCORES)


_SEED_SCORES = {f"seed_{i}": f"(event_id * {m} % 10007) / 10007.0::DOUBLE + score_b" for i, m in enumerate((7919, 104729, 1299709))}


@query(f"{_replay_sql(_SEED_SCORES, (5,))}, n AS (SELECT arm, count(*) AS people FROM found GROUP BY 1) SELECT count(*) AS seeds, round(avg(people), 9) AS mean_people, round(stddev_pop(people), 9) AS sd_people FROM n")
def seed_level_recovery(spark, sf):
    ce = crossing_events(spark, sf)
    seeds = {f"seed_{i}": (F.col("event_id") * m % 10007 / F.lit(10007.0) + F.col("score_b")) for i, m in enumerate((7919, 104729, 1299709))}
    _, found, _ = simulate.replay(ce.where("split = 'test'").withColumns(seeds), earliest(ce, F.col("seizure")), tuple(seeds), (5,))
    per = found.groupBy("arm").agg(F.count(F.lit(1)).alias("people"))
    return per.agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("people"), 9).alias("mean_people"), F.round(F.stddev_pop("people"), 9).alias("sd_people"))


@query(f"""WITH {CE}, p AS (SELECT * FROM ce LEFT JOIN caught USING (identity) WHERE split = 'test'), e AS (SELECT *, (caught_time IS NULL OR caught_time >= day) AS ok FROM p)
 SELECT count(*) FILTER (ok) AS candidate_events, count(*) FILTER (ok AND hidden) AS hidden_events, count(DISTINCT CASE WHEN ok AND hidden THEN identity END) AS hidden_people, count(*) FILTER (NOT ok) AS excluded_events,
 count(DISTINCT CASE WHEN NOT ok THEN identity END) AS excluded_people, count(*) FILTER (NOT ok AND hidden) AS excluded_hidden_events, count(DISTINCT CASE WHEN NOT ok AND hidden THEN identity END) AS excluded_hidden_people FROM e""")
def initial_pool(spark, sf):
    ce = crossing_events(spark, sf)
    rows = ce.where("split = 'test'").join(earliest(ce, F.col("seizure")), "identity", "left").withColumn("ok", F.col("caught_time").isNull() | (F.col("caught_time") >= F.col("day")))
    ok, hidden, who = F.col("ok"), F.col("hidden"), F.col("identity")
    return rows.agg(
        F.count_if(ok).alias("candidate_events"),
        F.count_if(ok & hidden).alias("hidden_events"),
        F.count_distinct(F.when(ok & hidden, who)).alias("hidden_people"),
        F.count_if(~ok).alias("excluded_events"),
        F.count_distinct(F.when(~ok, who)).alias("excluded_people"),
        F.count_if(~ok & hidden).alias("excluded_hidden_events"),
        F.count_distinct(F.when(~ok & hidden, who)).alias("excluded_hidden_people"),
    )


_REPS = 20
_SAMPLE = f"""p AS (SELECT row_ix, day, hidden, score_a, score_b, row_number() OVER (ORDER BY row_ix) - 1 AS place, count(*) OVER () AS total FROM ce WHERE split = 'test'), reps AS (SELECT unnest(range(0, {_REPS}))::INT AS rep),
 d AS (SELECT rep, place AS slot, ('0x' || substr(md5(rep || ':' || place), 1, 8))::BIGINT % total AS place FROM p, reps), x AS (SELECT d.rep, d.slot, p.* EXCLUDE (place, total) FROM d JOIN p USING (place))"""
_SUMMARY = "SELECT k, round(avg(d), 6) AS mean_diff, round(quantile_cont(d::DOUBLE, 0.025), 6) AS lo, round(quantile_cont(d::DOUBLE, 0.975), 6) AS hi, round(avg(CASE WHEN d <= 0 THEN 1 ELSE 0 END), 6) AS p_not_better, quantile_cont(d::DOUBLE, 0.025) > 0 AS significant FROM m GROUP BY k"


def _boot_sql(ks: tuple[int, ...], within: str) -> str:
    return f"""WITH {CE}, {_SAMPLE}, r AS (SELECT rep, hidden, row_number() OVER (PARTITION BY rep{within} ORDER BY score_b DESC, slot) AS ra, row_number() OVER (PARTITION BY rep{within} ORDER BY score_a DESC, slot) AS rb FROM x),
 ks AS (SELECT unnest([{', '.join(map(str, ks))}])::INT AS k), m AS (SELECT rep, k, count(*) FILTER (hidden AND ra <= k) - count(*) FILTER (hidden AND rb <= k) AS d FROM r, ks GROUP BY rep, k) {_SUMMARY}"""


def _boot(spark, sf, ks, *within):
    pool = crossing_events(spark, sf).where("split = 'test'").select("row_ix", "day", "hidden", *SCORES)
    out = bootstrap.difference_summary(bootstrap.paired_differences(bootstrap.resample(pool, _REPS), "score_b", "score_a", ks, *within))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_diff", "lo", "hi", "p_not_better")})


@query(_boot_sql((50, 250), ""))
def paired_bootstrap(spark, sf):
    return _boot(spark, sf, (50, 250))


@query(_boot_sql((5, 10), ", day"))
def paired_daily_bootstrap(spark, sf):
    return _boot(spark, sf, (5, 10), "day")


@query(f"""WITH {CE}, p AS (SELECT row_ix, identity, day, score_a, score_b, {_PCT.format(s='score_a')} AS pa, {_PCT.format(s='score_b')} AS pb FROM ce WHERE split = 'test'), f AS (SELECT *, 0.7 * pb + 0.3 * pa AS fused FROM p)
 SELECT row_ix, round(0.3 * pa, 9) AS term_a, round(0.7 * pb, 9) AS term_b, row_number() OVER (PARTITION BY day ORDER BY score_a DESC, row_ix) AS base_rank, row_number() OVER (PARTITION BY day ORDER BY round(fused, 12) DESC, row_ix) AS fused_rank FROM f""")
def decision_trace(spark, sf):
    pool = crossing_events(spark, sf).where("split = 'test'").select("row_ix", "identity", "day", *SCORES)
    both = average_percentile(average_percentile(pool, "score_a", "pa"), "score_b", "pb").withColumn("fused", F.round(0.7 * F.col("pb") + 0.3 * F.col("pa"), 12))
    by_day = W.partitionBy("day")
    return both.select("row_ix", F.round(0.3 * F.col("pa"), 9).alias("term_a"), F.round(0.7 * F.col("pb"), 9).alias("term_b"), F.row_number().over(by_day.orderBy(F.col("score_a").desc(), "row_ix")).alias("base_rank"), F.row_number().over(by_day.orderBy(F.col("fused").desc(), "row_ix")).alias("fused_rank"))


@query("WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 250 AS page FROM orders) SELECT page, count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM r GROUP BY page")
def catalog_pages(spark, sf):
    from ..sources.adapter import table

    places = value_positions(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return places.groupBy(F.floor(F.col("before") / 250).alias("page")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"))


@query("""SELECT 'record_without_member' AS probe, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 5)
 UNION ALL SELECT 'member_without_record', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')""")
def provenance_reconcile(spark, sf):
    from ..sources.adapter import table

    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    one = orders.join(items.where("l_quantity > 5"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.lit("record_without_member").alias("probe"), F.count(F.lit(1)).alias("n"))
    two = items.select("l_orderkey").distinct().join(orders.where("o_orderstatus <> 'P'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.lit("member_without_record").alias("probe"), F.count(F.lit(1)).alias("n"))
    return one.unionByName(two)


_WORDS = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS w{i}" for i in range(8))


@query(f"WITH {CE}, x AS (SELECT region, sha256(event_id || '|' || identity) AS h FROM ce), w AS (SELECT region, {_WORDS} FROM x) SELECT region, count(*) AS n, {', '.join(f'sum(w{i})::BIGINT AS sum{i}, bit_xor(w{i}) AS xor{i}' for i in range(8))} FROM w GROUP BY region")
def multiset_fingerprint(spark, sf):
    """Order-free fingerprint of rows: count, sums and exclusive ors of their SHA-256 by 32-bit words (the 256-bit sum follows by carrying)."""
    h = F.sha2(F.concat_ws("|", "event_id", "identity"), 256)
    words = {f"w{i}": F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(8)}
    rows = crossing_events(spark, sf).select("region", *[w.alias(n) for n, w in words.items()])
    sums = [x for i in range(8) for x in (F.sum(f"w{i}").alias(f"sum{i}"), F.expr(f"bit_xor(w{i})").alias(f"xor{i}"))]
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), *sums)


_FRAME = "unhex(lpad(to_hex({n}), 16, '0'))"


@query(f"""WITH {CE}, p AS (SELECT day, event_id // 4096 AS part, count(*) AS n, sha256({_FRAME.format(n="count(*)")} || unhex(string_agg(lpad(to_hex(length(event_id::VARCHAR)), 16, '0') || hex(event_id::VARCHAR), '' ORDER BY event_id))) AS h FROM ce GROUP BY 1, 2)
 SELECT strftime(day, '%Y-%m-%d') AS day_text, sum(n)::BIGINT AS n, 'sha256:' || sha256({_FRAME.format(n="count(*)")} || unhex(string_agg(lpad(to_hex(64), 16, '0') || hex(h), '' ORDER BY part))) AS ids_hash FROM p GROUP BY day""")
def ordered_id_hash(spark, sf):
    """A day's ids in order: hashed in parts of at most 4,096 ids (count, then each id after its length), and the parts' hashes likewise."""
    return ordered_hash(crossing_events(spark, sf), "day", "event_id").select(F.date_format("day", "yyyy-MM-dd").alias("day_text"), "n", "ids_hash")


@query("""WITH v AS (SELECT c_custkey AS id, md5(c_mktsegment || '|' || c_nationkey) AS h FROM customer UNION ALL SELECT c_custkey, md5(CASE WHEN c_custkey % 97 = 0 THEN 'x' ELSE c_mktsegment || '|' || c_nationkey END) FROM customer)
 SELECT id, count(*) AS versions, count(DISTINCT h) > 1 AS conflict FROM v GROUP BY id""")
def catalog_upsert_conflicts(spark, sf):
    from ..sources.adapter import table

    c = table(spark, sf, "customer")
    body = F.concat_ws("|", "c_mktsegment", "c_nationkey")
    first, second = c.select(F.col("c_custkey").alias("id"), F.md5(body).alias("h")), c.select(F.col("c_custkey").alias("id"), F.md5(F.when(F.col("c_custkey") % 97 == 0, F.lit("x")).otherwise(body)).alias("h"))
    return first.union(second).groupBy("id").agg(F.count(F.lit(1)).alias("versions"), (F.count_distinct("h") > 1).alias("conflict"))


@query(f"""WITH {CE}, m AS (SELECT identity, (event_id % 3) AS restart, value / max(value) OVER (PARTITION BY event_id % 3) AS w FROM ce WHERE split = 'test')
 SELECT identity, round(median(w), 9) AS mid, round(quantile_cont(w, 0.25), 9) AS q1, round(quantile_cont(w, 0.75), 9) AS q3, CASE WHEN quantile_cont(w, 0.75) - quantile_cont(w, 0.25) <= 0.25 AND count(DISTINCT restart) >= 2 THEN 'stable' ELSE 'unstable' END AS status FROM m GROUP BY identity""")
def mask_stability(spark, sf):
    rows = crossing_events(spark, sf).where("split = 'test'").select("identity", (F.col("event_id") % 3).alias("restart"), "value")
    peak = rows.groupBy("restart").agg(F.max("value").alias("peak"))
    w = rows.join(F.broadcast(peak), "restart").select("identity", "restart", (F.col("value") / F.col("peak")).alias("w"))
    out = w.groupBy("identity").agg(F.percentile("w", 0.5).alias("mid"), F.percentile("w", 0.25).alias("q1"), F.percentile("w", 0.75).alias("q3"), F.count_distinct("restart").alias("runs"))
    status = F.when((F.col("q3") - F.col("q1") <= 0.25) & (F.col("runs") >= 2), "stable").otherwise("unstable")
    return out.select("identity", *[F.round(c, 9).alias(c) for c in ("mid", "q1", "q3")], status.alias("status"))
