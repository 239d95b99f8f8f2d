"""Roll-ups in the shape of an outcome dashboard, over orders, customers and line items."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.adapter import CE, crossing_events, table
from .registry import query

_OC = "orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


def order_facts(spark, sf):
    """orders with customer, nation and region: the dimensions are small tables that Spark broadcasts by their size."""
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY 1")
def monthly_outcomes(spark, sf):
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(status == s.upper()).alias(s) for s in "fop"], F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@query(f"SELECT year(o_orderdate)::INT AS fy, r_name AS region, count(*) AS n FROM {_OC} GROUP BY GROUPING SETS ((1), (1, 2))")
def fy_region(spark, sf):
    rows = order_facts(spark, sf).select(F.year("o_orderdate").alias("fy"), F.col("r_name").alias("region"))
    return rows.groupingSets([["fy"], ["fy", "region"]], "fy", "region").agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT d, h FROM range(0, 7) t(d), range(0, 24) u(h)), c AS (SELECT dayofweek(ts) AS d, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2) SELECT s.d::INT AS dow, s.h::INT AS hour, coalesce(n, 0) AS n FROM s LEFT JOIN c ON c.d = s.d AND c.h = s.h")
def dow_hour_heatmap(spark, sf):
    cells = spark.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    counts = table(spark, sf, "events").groupBy((F.dayofweek("ts") - 1).alias("dow"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(F.broadcast(counts), ["dow", "hour"], "left").select("dow", "hour", F.coalesce("n", F.lit(0)).alias("n"))


_DIMS = {"region": "r_name", "nation": "n_name", "segment": "c_mktsegment", "priority": "o_orderpriority", "status": "o_orderstatus"}


@query(" UNION ALL ".join(f"SELECT '{d}' AS dimension, {c} AS value, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS large, round(count(*) FILTER (o_totalprice > 200000) / count(*), 9) AS rate FROM {_OC} GROUP BY {c}" for d, c in _DIMS.items()))
def outcome_by_dimension(spark, sf):
    """All dimensions in one pass: each row is counted under (dimension, value) after the joins, and summed in the map tasks."""
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in _DIMS.items()])).alias("x")
    rows = order_facts(spark, sf).select(cells, (F.col("o_totalprice") > 200000).alias("large"))
    out = rows.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"), F.count_if("large").alias("large"))
    return out.withColumn("rate", F.round(F.col("large") / F.col("n"), 9))


@query("SELECT s_nationkey AS port, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, max_by(l_returnflag, (l_orderkey, l_linenumber)) FILTER (l_returnflag <> 'N') AS last_flag FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def port_rollup(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    last = F.max_by(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.when(F.col("l_returnflag") != "N", F.struct("l_orderkey", "l_linenumber")))
    return rows.groupBy(F.col("s_nationkey").alias("port")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"), last.alias("last_flag"))


@query(f"""WITH f AS (SELECT n_name AS state, c_custkey, c_mktsegment AS segment FROM {_OC}), t AS (SELECT state, count(*) AS n, count(DISTINCT c_custkey) AS travellers FROM f GROUP BY 1),
 s AS (SELECT state, segment, count(*) AS k FROM f GROUP BY 1, 2), b AS (SELECT state, min_by(segment, (-k, segment)) AS top_segment FROM s GROUP BY 1), r AS (SELECT n_name AS state, count(*) AS residents FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
 SELECT state, n, travellers, top_segment, residents, greatest(0, travellers - residents) AS visitors FROM t JOIN b USING (state) JOIN r USING (state)""")
def state_map(spark, sf):
    f = order_facts(spark, sf).select(F.col("n_name").alias("state"), "c_custkey", F.col("c_mktsegment").alias("segment"))
    totals = f.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("travellers"))
    best = f.groupBy("state", "segment").agg(F.count(F.lit(1)).alias("k")).groupBy("state").agg(F.min_by("segment", F.struct((-F.col("k")).alias("k"), "segment")).alias("top_segment"))
    residents = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("state")).agg(F.count(F.lit(1)).alias("residents"))
    return totals.join(best, "state").join(residents, "state").withColumn("visitors", F.greatest(F.lit(0), F.col("travellers") - F.col("residents")))


@query("""WITH f AS (SELECT a.n_name AS origin, b.n_name AS destination, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
 JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey GROUP BY 1, 2) SELECT * FROM f ORDER BY n DESC, origin, destination LIMIT 100""")
def flows_top(spark, sf):
    items, s, o, c, n = (table(spark, sf, t) for t in ("lineitem", "supplier", "orders", "customer", "nation"))
    pairs = items.select("l_orderkey", "l_suppkey").join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    counts = pairs.groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("origin")), "s_nationkey").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("destination")), "c_nationkey")
    return named.select("origin", "destination", "n").orderBy(F.col("n").desc(), "origin", "destination").limit(100)


@query("""SELECT id, bit_or(bit)::INT AS roles FROM (SELECT o_custkey AS id, 1 AS bit FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 2 FROM orders WHERE o_totalprice > 250000
 UNION ALL SELECT c_custkey, 4 FROM customer WHERE c_acctbal < 0 UNION ALL SELECT o_custkey, 8 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') GROUP BY id""")
def role_bitmask(spark, sf):
    o, c, items = (table(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    parts = [o.where("o_orderstatus = 'O'").select("o_custkey", F.lit(1)), o.where("o_totalprice > 250000").select("o_custkey", F.lit(2)), c.where("c_acctbal < 0").select("c_custkey", F.lit(4))]
    parts.append(o.join(items.where("l_returnflag = 'R'").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_custkey", F.lit(8)))
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).toDF("id", "bit")
    return every.groupBy("id").agg(F.bit_or("bit").alias("roles"))


@query("SELECT c_mktsegment AS kind, count(*) AS n, round(min(c_acctbal), 6) AS lo, round(max(c_acctbal), 6) AS hi, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 6) AS mid, count(*) FILTER (c_acctbal < 0) AS negative FROM customer GROUP BY 1")
def community_stats(spark, sf):
    b = "c_acctbal"
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min(b), 6).alias("lo"), F.round(F.max(b), 6).alias("hi"), F.round(F.avg(b), 4).alias("mean"), F.round(F.median(b), 6).alias("mid"), F.count_if(F.col(b) < 0).alias("negative"))


@query("WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) SELECT CASE WHEN size = 1 THEN '1' WHEN size <= 4 THEN '2-4' WHEN size <= 8 THEN '5-8' ELSE '9+' END AS bucket, count(*) AS n FROM s GROUP BY 1")
def size_histogram(spark, sf):
    size = F.col("size")
    bucket = F.when(size == 1, "1").when(size <= 4, "2-4").when(size <= 8, "5-8").otherwise("9+")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_TIES = """ties AS (SELECT least(a.l_suppkey, b.l_suppkey) AS a, greatest(a.l_suppkey, b.l_suppkey) AS b, bit_or(CASE WHEN a.l_returnflag = 'R' THEN 2 ELSE 1 END)::INT AS bits, count(*) AS w
 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2)"""


def tie_rows(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    a, b = items.alias("a"), items.select("l_orderkey", F.col("l_linenumber").alias("n2"), F.col("l_suppkey").alias("s2"))
    pairs = a.join(b, "l_orderkey").where("l_linenumber < n2 AND l_suppkey <> s2")
    bit = F.when(F.col("l_returnflag") == "R", 2).otherwise(1)
    return pairs.groupBy(F.least("l_suppkey", "s2").alias("a"), F.greatest("l_suppkey", "s2").alias("b")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("w"))


@query(f"WITH {_TIES} SELECT * FROM ties")
def tie_graph(spark, sf):
    return tie_rows(spark, sf)


@query(f"WITH {_TIES}, d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM ties UNION ALL SELECT b FROM ties) GROUP BY 1) SELECT min(degree) AS lo, max(degree) AS hi, round(avg(degree), 6) AS mean, median(degree) AS mid, (list_sort(list(degree)))[(least(count(*) - 1, floor(0.95 * count(*))) + 1)::INT] AS p95 FROM d")
def degree_stats(spark, sf):
    ties = tie_rows(spark, sf)
    d = ties.select(F.col("a").alias("node")).union(ties.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    freq = d.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(F.lit(0)).orderBy("degree")
    pick = freq.select("degree", F.sum("n").over(w).alias("upto"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("total"))
    p95 = pick.where(F.col("upto") > F.least(F.col("total") - 1, F.floor(0.95 * F.col("total")))).agg(F.min("degree").alias("p95"))
    return d.agg(F.min("degree").alias("lo"), F.max("degree").alias("hi"), F.round(F.avg("degree"), 6).alias("mean"), F.median("degree").alias("mid")).crossJoin(p95)


@query(f"WITH {_TIES}, flag AS (SELECT s_suppkey, s_acctbal < 0 AS bad FROM supplier), e AS (SELECT a AS x, b AS y FROM ties UNION ALL SELECT b, a FROM ties) SELECT x AS node, bool_or(bad) AS near_bad, count(*) AS degree FROM e JOIN flag ON s_suppkey = y GROUP BY x")
def neighbor_flags(spark, sf):
    ties = tie_rows(spark, sf)
    ends = ties.select(F.col("a").alias("node"), F.col("b").alias("y")).union(ties.select("b", "a"))
    flags = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("y"), (F.col("s_acctbal") < 0).alias("bad"))
    return ends.join(flags, "y").groupBy("node").agg(F.bool_or("bad").alias("near_bad"), F.count(F.lit(1)).alias("degree"))


@query(f"WITH {_TIES} SELECT x.s_nationkey AS n1, y.s_nationkey AS n2, count(*) AS n FROM ties JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b GROUP BY 1, 2 ORDER BY n DESC, n1, n2 LIMIT 15")
def type_pairs_top(spark, sf):
    s = table(spark, sf, "supplier")
    rows = tie_rows(spark, sf).join(s.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("n1")), "a").join(s.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("n2")), "b")
    return rows.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "n1", "n2").limit(15)


@query(f"""WITH RECURSIVE {_TIES}, t AS (SELECT *, row_number() OVER (ORDER BY w DESC, a DESC, b DESC, bits DESC) AS rn FROM ties), n AS (SELECT max(s_suppkey) + 1 AS size FROM supplier),
 r(rn, used, ok) AS (SELECT 0::BIGINT, list_transform(range(0, size), lambda x: 0), false FROM n
  UNION ALL SELECT t.rn, CASE WHEN used[t.a + 1] < 8 AND used[t.b + 1] < 8 THEN list_transform(used, lambda x, i: x + CASE WHEN i = t.a + 1 OR i = t.b + 1 THEN 1 ELSE 0 END) ELSE used END, used[t.a + 1] < 8 AND used[t.b + 1] < 8 FROM r JOIN t ON t.rn = r.rn + 1)
 SELECT a, b, bits, w FROM t JOIN r USING (rn) WHERE ok""")
def capped_links(spark, sf):
    """Strongest links first, at most eight for each node."""
    from ..operators.links import capped

    return capped(tie_rows(spark, sf), 8)


@query(f"WITH {_TIES}, k AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 0), r AS (SELECT node, y, row_number() OVER (PARTITION BY node ORDER BY w DESC, y) AS rk FROM k JOIN (SELECT a AS x, b AS y, w FROM ties UNION ALL SELECT b, a, w FROM ties) ON x = node) SELECT node FROM k UNION SELECT y FROM r WHERE rk <= 5")
def node_sample(spark, sf):
    ties = tie_rows(spark, sf)
    ends = ties.select(F.col("a").alias("node"), F.col("b").alias("y"), "w").union(ties.select("b", "a", "w"))
    seeds = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    near = ends.join(seeds, "node", "left_semi").withColumn("rk", F.row_number().over(W.partitionBy("node").orderBy(F.col("w").desc(), "y"))).where("rk <= 5")
    return seeds.union(near.select("y")).distinct()


@query("SELECT p_type AS kind, count(*) AS n, sum(l_quantity)::BIGINT AS total, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1")
def seizure_stats(spark, sf):
    q = "l_quantity"
    rows = table(spark, sf, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(q).cast("bigint").alias("total"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.round(F.avg(q), 6).alias("mean"))


@query("WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1) SELECT value, n FROM c ORDER BY n DESC, value LIMIT 10")
def counter_top(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(10)


@query("WITH c AS (SELECT r_name AS region, n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, nation) AS rk FROM c) SELECT * FROM r WHERE rk <= 3")
def top3_per_region(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    counts = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rk", F.row_number().over(W.partitionBy("region").orderBy(F.col("n").desc(), "nation"))).where("rk <= 3")


@query(f"WITH {CE} SELECT CASE WHEN score_b >= 0.62 AND hidden THEN 'tp' WHEN score_b >= 0.62 THEN 'fp' WHEN hidden THEN 'fn' ELSE 'tn' END AS status, count(*) AS n, round(avg(score_b), 9) AS mean FROM ce GROUP BY 1")
def confusion(spark, sf):
    ce = crossing_events(spark, sf)
    hit = F.col("score_b") >= 0.62
    status = F.when(hit & F.col("hidden"), "tp").when(hit, "fp").when(F.col("hidden"), "fn").otherwise("tn")
    return ce.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score_b"), 9).alias("mean"))


@query("SELECT c_custkey AS id, 1103515245 * c_custkey + 12345 & 2147483647 AS raw, ((1103515245 * c_custkey + 12345) & 2147483647) % 101 AS jitter, round(1 / (1 + exp(-(c_acctbal / 5000.0::DOUBLE - 0.5::DOUBLE))), 9) AS p FROM customer")
def risk_model(spark, sf):
    from ..functions.parse import lcg_jitter, logistic

    raw = (F.col("c_custkey") * 1103515245 + 12345).bitwiseAND(F.lit(0x7FFFFFFF))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), raw.alias("raw"), lcg_jitter(F.col("c_custkey")).alias("jitter"), F.round(logistic(F.col("c_acctbal") / 5000.0 - 0.5), 9).alias("p"))
