"""Contracts between tables: keys, order, coverage, payloads, finite numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import contracts
from ..operators.asof import earliest
from ..sources.adapter import CE, crossing_events, table
from .registry import query


@query(f"""WITH {CE}, a AS (SELECT event_id FROM ce WHERE event_id % 13 <> 0 UNION ALL SELECT event_id FROM ce WHERE event_id % 97 = 1), b AS (SELECT event_id FROM ce WHERE event_id % 11 <> 0),
 x AS (SELECT event_id, count(*) AS n FROM a GROUP BY 1), y AS (SELECT event_id, count(*) AS n FROM b GROUP BY 1)
 SELECT CASE WHEN x.event_id IS NULL THEN 'right_only' WHEN y.event_id IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS keys, count(*) FILTER (greatest(coalesce(x.n, 0), coalesce(y.n, 0)) > 1) AS repeated FROM x FULL JOIN y ON x.event_id = y.event_id GROUP BY 1""")
def one_to_one_audit(spark, sf):
    ce = crossing_events(spark, sf).select("event_id")
    events = ce.where("event_id % 13 <> 0").union(ce.where("event_id % 97 = 1"))
    return contracts.join_audit(events, ce.where("event_id % 11 <> 0"), "event_id")


@query(f"WITH {CE} SELECT row_ix, event_id, round(score_b, 9) AS score, score_b >= 0.65 AS selected, hidden, hidden OR seizure AS carrier FROM ce WHERE split = 'test'")
def frozen_with_oracle(spark, sf):
    """Scores are frozen first, what was true is joined after, each event once on either side."""
    test = crossing_events(spark, sf).where("split = 'test'")
    frozen = test.select("row_ix", "event_id", "identity", F.round("score_b", 9).alias("score"), (F.col("score_b") >= 0.65).alias("selected"))
    oracle = test.select("event_id", "identity", "hidden", (F.col("hidden") | F.col("seizure")).alias("carrier"))
    return contracts.frozen_with_oracle(frozen, oracle).select("row_ix", "event_id", "score", "selected", "hidden", "carrier")


_CONTRACT = "train<2024-01-15; validation<2024-01-22; test>=2024-01-22"


@query(f"WITH s AS (SELECT DISTINCT '{_CONTRACT}' AS c FROM events) SELECT trim(regexp_extract(c, 'train<([^;]+);', 1)) AS train_cutoff, trim(regexp_extract(c, 'test>=([^;]+)', 1)) AS test_cutoff, count(*) AS contracts FROM s GROUP BY 1, 2")
def split_contract(spark, sf):
    rows = table(spark, sf, "events").select(F.lit(_CONTRACT).alias("temporal_cutoff"))
    train, test = parse.split_contract(rows)
    return spark.createDataFrame([(train.date().isoformat(), test.date().isoformat(), 1)], "train_cutoff string, test_cutoff string, contracts long")


@query("SELECT key, count(*) AS n, key IN ('k', 'label') AS forbidden FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def payload_keys(spark, sf):
    """Keys of the events' payloads, and whether they are among those that must not be published."""
    keys = table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("forbidden", F.col("key").isin("k", "label"))


_ODD = "CASE event_id % 50 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN NULL ELSE value END"


@query(f"WITH x AS (SELECT event_type, {_ODD} AS s FROM events) SELECT event_type, count(*) AS n, count(*) FILTER (NOT coalesce(isfinite(s), false)) AS not_finite FROM x GROUP BY event_type")
def finite_scores(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.expr(_ODD).alias("s"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~parse.is_finite(F.col("s"))).alias("not_finite"))


@query("""WITH n AS (SELECT s_suppkey AS node FROM supplier WHERE s_suppkey % 19 <> 0), e AS (SELECT DISTINCT l_suppkey AS node FROM lineitem), x AS (SELECT node FROM e WHERE node NOT IN (SELECT node FROM n))
 SELECT (SELECT count(*) FROM x) AS missing, (SELECT string_agg(node::VARCHAR, ',' ORDER BY node) FROM (SELECT node FROM x ORDER BY node LIMIT 5)) AS examples""")
def endpoints_known(spark, sf):
    """Ends of edges that are no nodes, and the first five."""
    nodes = table(spark, sf, "supplier").where("s_suppkey % 19 <> 0").select(F.col("s_suppkey").alias("node"))
    lost = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("node")).distinct().join(nodes, "node", "left_anti")
    five = lost.orderBy("node").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), ",").alias("examples"))
    return lost.agg(F.count(F.lit(1)).alias("missing")).crossJoin(five.select(F.nullif("examples", F.lit("")).alias("examples")))


@query(f"""WITH {CE}, p AS (SELECT DISTINCT identity FROM ce WHERE split = 'test'), c AS (SELECT identity FROM p WHERE length(identity) % 2 = 0 UNION ALL SELECT identity FROM p WHERE identity LIKE '%-3' UNION ALL SELECT 'nobody'), q AS (SELECT identity, count(*) AS places FROM c GROUP BY 1)
 SELECT 'uncovered' AS rule, count(*) FILTER (q.identity IS NULL) AS n FROM p LEFT JOIN q USING (identity) UNION ALL SELECT 'covered_twice', count(*) FILTER (places > 1) FROM p JOIN q USING (identity) UNION ALL SELECT 'unknown', count(*) FROM q WHERE identity NOT IN (SELECT identity FROM p)""")
def cohort_coverage(spark, sf):
    people = crossing_events(spark, sf).where("split = 'test'").select("identity").distinct()
    cohorts = people.where("length(identity) % 2 = 0").union(people.where("identity LIKE '%-3'")).union(spark.createDataFrame([("nobody",)], "identity string"))
    return contracts.exactly_once(people, cohorts)


@query(f"""WITH {CE}, d AS (SELECT event_id, identity, label_available FROM ce WHERE seizure), h AS (SELECT identity, min(label_available) AS caught_time, count(*) AS sources FROM d WHERE event_id % 23 <> 0 GROUP BY 1)
 SELECT (SELECT count(*) FROM h) AS people, (SELECT count(*) FROM d) AS catches, (SELECT count(*) FROM d WHERE event_id % 23 = 0) AS uncovered_events, (SELECT count(DISTINCT identity) FROM d WHERE identity NOT IN (SELECT identity FROM h)) AS people_without_history, (SELECT strftime(min(caught_time), '%Y-%m-%d %H:%M:%S') FROM h) AS first_catch""")
def catch_history_audit(spark, sf):
    """Official catches by person, and what the history does not cover."""
    ce = crossing_events(spark, sf)
    catches = ce.where("seizure").select("event_id", "identity", "label_available")
    covered = catches.where("event_id % 23 <> 0")
    history = earliest(covered, F.lit(True))
    lost = catches.join(history, "identity", "left_anti").agg(F.count_distinct("identity").alias("people_without_history"))
    whole = catches.agg(F.count(F.lit(1)).alias("catches"), F.count_if(F.col("event_id") % 23 == 0).alias("uncovered_events"))
    people = history.agg(F.count(F.lit(1)).alias("people"), F.date_format(F.min("caught_time"), "yyyy-MM-dd HH:mm:ss").alias("first_catch"))
    return people.crossJoin(whole).crossJoin(lost)


@query(f"WITH {CE}, w AS (SELECT event_id, row_number() OVER (ORDER BY md5(event_id::VARCHAR), event_id) - 1 AS place FROM ce WHERE event_id % 40 = 7) SELECT place, event_id, identity, k AS hour FROM w JOIN ce USING (event_id)")
def rows_in_asked_order(spark, sf):
    """Feature rows in the order in which events are asked for."""
    ce = crossing_events(spark, sf)
    from ..functions.rank import text_positions

    asked = text_positions(ce.where("event_id % 40 = 7").select("event_id", F.md5(F.col("event_id").cast("string")).alias("draw")), "draw", "event_id", "place")
    return asked.select("event_id", "place").join(ce.select("event_id", "identity", F.col("k").alias("hour")), "event_id").select("place", "event_id", "identity", "hour")


@query(f"WITH {CE}, a AS (SELECT identity, min(day) AS day FROM ce WHERE split = 'test' AND hidden GROUP BY 1) SELECT identity, strftime(day, '%Y-%m-%d') AS day_text, string_agg(row_ix::VARCHAR, ' ' ORDER BY row_ix) AS same_day_rows FROM a JOIN ce USING (identity, day) WHERE split = 'test' GROUP BY identity, day")
def same_day_rows(spark, sf):
    """All rows of a person on the day of the first hidden one."""
    test = crossing_events(spark, sf).where("split = 'test'")
    anchors = test.where("hidden").groupBy("identity").agg(F.min("day").alias("day"))
    rows = test.join(anchors, ["identity", "day"]).groupBy("identity", "day").agg(F.array_sort(F.collect_list("row_ix")).alias("rows"))
    return rows.select("identity", F.date_format("day", "yyyy-MM-dd").alias("day_text"), F.array_join(F.transform("rows", lambda x: x.cast("string")), " ").alias("same_day_rows"))


_SIDES = "a AS (SELECT DISTINCT identity FROM ce WHERE split = 'train'), b AS (SELECT DISTINCT identity FROM ce WHERE split = 'test')"


@query(f"""WITH {CE}, {_SIDES}, m AS (SELECT 'missing' AS side, identity FROM a WHERE identity NOT IN (SELECT identity FROM b) UNION ALL SELECT 'unexpected', identity FROM b WHERE identity NOT IN (SELECT identity FROM a)), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY identity) AS rk FROM m)
 SELECT side, count(*) AS n, string_agg(identity, ',' ORDER BY identity) FILTER (rk <= 3) AS examples FROM r GROUP BY side""")
def set_difference_samples(spark, sf):
    """Ids that one side lacks, counted, with the first three."""
    ce = crossing_events(spark, sf)
    a, b = (ce.where(F.col("split") == s).select("identity").distinct() for s in ("train", "test"))
    both = a.join(b, "identity", "left_anti").select(F.lit("missing").alias("side"), "identity").unionByName(b.join(a, "identity", "left_anti").select(F.lit("unexpected").alias("side"), "identity"))
    from pyspark.sql import Window as W

    first = both.withColumn("rk", F.row_number().over(W.partitionBy("side").orderBy("identity"))).where("rk <= 3").groupBy("side").agg(F.array_join(F.array_sort(F.collect_list("identity")), ",").alias("examples"))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n")).join(first, "side")


_WHO = "CASE event_id % 60 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'stranger-' || event_id ELSE identity END"


@query(f"""WITH {CE}, u AS (SELECT DISTINCT identity AS node FROM ce), p AS (SELECT event_id, {_WHO} AS who FROM ce), x AS (SELECT event_id, CASE WHEN who IS NULL THEN 'unmapped' WHEN trim(who) = '' THEN 'blank' WHEN who NOT IN (SELECT node FROM u) THEN 'outside' END AS rule FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY event_id) AS rk FROM x WHERE rule IS NOT NULL) SELECT rule, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (rk <= 5) AS examples FROM r GROUP BY rule""")
def pool_identities(spark, sf):
    """Rows whose person is unmapped, blank or no node of the graph, with the first five events of each."""
    ce = crossing_events(spark, sf)
    universe = ce.select(F.col("identity").alias("who")).distinct().withColumn("known", F.lit(True))
    rows = ce.select("event_id", F.expr(_WHO).alias("who")).join(universe, "who", "left")
    rule = F.when(F.col("who").isNull(), "unmapped").when(F.trim("who") == "", "blank").when(F.col("known").isNull(), "outside")
    broken = rows.withColumn("rule", rule).where("rule IS NOT NULL")
    first = broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    five = broken.withColumn("rk", F.row_number().over(W.partitionBy("rule").orderBy("event_id"))).where("rk <= 5").groupBy("rule").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return first.join(five, "rule").select("rule", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("examples"))
