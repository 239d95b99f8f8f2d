"""More roll-ups of the dashboard: flows, counters, communities, ties, samples and drills."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import ties
from ..sources.adapter import CE, crossing_events, table
from .dashboard import _OC, order_facts
from .registry import query


def _n():
    return F.count(F.lit(1)).alias("n")



@query(f"""WITH {CE} SELECT split, count(*) AS n, count(*) FILTER (secondary) AS secondary, count(*) FILTER (searched) AS searched, count(*) FILTER (seizure) AS seizure, count(*) FILTER (arrest) AS arrest,
 round(count(*) FILTER (secondary) / count(*), 9) AS secondary_rate, round(count(*) FILTER (searched) / count(*), 9) AS searched_rate, round(count(*) FILTER (seizure) / count(*), 9) AS seizure_rate, round(count(*) FILTER (arrest) / count(*), 9) AS arrest_rate FROM ce GROUP BY split""")
def split_outcome_rates(spark, sf):
    flags = ("secondary", "searched", "seizure", "arrest")
    counts = crossing_events(spark, sf).groupBy("split").agg(_n(), *[F.count_if(F.col(f)).alias(f) for f in flags])
    return counts.withColumns({f"{f}_rate": F.round(F.col(f) / F.col("n"), 9) for f in flags})


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter_start, count(*) AS n FROM orders GROUP BY 1, 2")
def bucket_starts(spark, sf):
    starts = [F.date_format(parse.bucket_start(F.col("o_orderdate"), unit), "yyyy-MM-dd").alias(f"{unit}_start") for unit in ("month", "quarter")]
    return table(spark, sf, "orders").groupBy(*starts).agg(_n())


_STAMPS = "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '2024' WHEN 2 THEN NULL ELSE {text} END"


@query(f"WITH x AS (SELECT {_STAMPS.format(text="strftime(ts, '%Y-%m-%dT%H:%M:%S')")} AS s FROM events) SELECT CASE WHEN length(s) >= 7 THEN substr(s, 1, 7) ELSE '?' END AS month, count(*) AS n FROM x GROUP BY 1")
def month_slices(spark, sf):
    stamp = F.expr(_STAMPS.format(text="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"))
    return table(spark, sf, "events").groupBy(parse.month_of(stamp).alias("month")).agg(_n())


_PLACE = "CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 7 = 1 THEN NULL ELSE event_type END"


@query(f"WITH x AS (SELECT {_PLACE} AS place, value > 60 AS searched FROM events) SELECT place, count(*) AS n, count(*) FILTER (searched) AS searched FROM x WHERE place IS NOT NULL AND place <> '' GROUP BY place")
def filled_places(spark, sf):
    rows = table(spark, sf, "events").select(F.expr(_PLACE).alias("place"), (F.col("value") > 60).alias("searched"))
    return rows.where(parse.bool_filled(F.col("place"))).groupBy("place").agg(_n(), F.count_if("searched").alias("searched"))


#: Flow kinds: their parts out of o(rigin), s(tate), p(ort), m(ode), d(estination), and how many rows are shown.
_FLOWS = {"origin_state": ("os", 100), "origin_port": ("op", 200), "origin_port_mode": ("opm", 500), "origin_destination": ("od", 200), "port_destination": ("pd", 250)}
_FLOW_ROWS = """f AS (SELECT a.n_name AS o, b.n_name AS s, l_returnflag || l_linestatus AS p, p_type AS m, r_name AS d FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
 JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey JOIN region ON r_regionkey = b.n_regionkey JOIN part ON p_partkey = l_partkey)"""


def _flow_rows(spark, sf):
    items, s, o, c, n, r, p = (table(spark, sf, t) for t in ("lineitem", "supplier", "orders", "customer", "nation", "region", "part"))
    rows = items.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    named = rows.join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("o")), "s_nationkey").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("s"), "n_regionkey"), "c_nationkey")
    return named.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("o", "s", F.concat("l_returnflag", "l_linestatus").alias("p"), F.col("p_type").alias("m"), F.col("r_name").alias("d"))


@query(f"WITH {_FLOW_ROWS}, c AS ({' UNION ALL '.join(f"SELECT '{kind}' AS kind, {' || \' > \' || '.join(parts)} AS flow, count(*) AS n, {most} AS most FROM f GROUP BY 2" for kind, (parts, most) in _FLOWS.items())}), r AS (SELECT kind, flow, n, most, row_number() OVER (PARTITION BY kind ORDER BY n DESC, flow) AS rk FROM c) SELECT kind, flow, n, rk FROM r WHERE rk <= most")
def flow_kinds_top(spark, sf):
    """All five kinds in one pass: rows are counted by their finest parts first, and the kinds are sums of these counts."""
    finest = _flow_rows(spark, sf).groupBy("o", "s", "p", "m", "d").agg(_n())
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.concat_ws(" > ", *parts).alias("flow"), F.lit(most).alias("most")) for kind, (parts, most) in _FLOWS.items()]))
    counts = finest.select("n", kinds.alias("x")).groupBy("x.kind", "x.flow", "x.most").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rk", F.row_number().over(W.partitionBy("kind").orderBy(F.col("n").desc(), "flow")))
    return ranked.where("rk <= most").select("kind", "flow", "n", "rk")


@query(f"""WITH {_FLOW_ROWS}, c AS (SELECT o, s, count(*) AS n FROM f GROUP BY 1, 2 ORDER BY n DESC, o, s LIMIT 500), g AS (SELECT n_name, n_nationkey * 7 - 80 AS lat, n_nationkey * 11 - 130 AS lon FROM nation WHERE n_nationkey % 6 <> 5)
 SELECT o AS origin, s AS state, n, a.lat AS from_lat, a.lon AS from_lon, b.lat AS to_lat, b.lon AS to_lon FROM c JOIN g a ON a.n_name = o JOIN g b ON b.n_name = s""")
def flows_on_map(spark, sf):
    """Ends without coordinates go after the cut, so fewer rows than the cut may be left."""
    top = _flow_rows(spark, sf).groupBy("o", "s").agg(_n()).orderBy(F.col("n").desc(), "o", "s").limit(500)
    places = table(spark, sf, "nation").where("n_nationkey % 6 <> 5").select("n_name", (F.col("n_nationkey") * 7 - 80).alias("lat"), (F.col("n_nationkey") * 11 - 130).alias("lon"))
    ends = [places.toDF(key, f"{side}_lat", f"{side}_lon") for key, side in (("o", "from"), ("s", "to"))]
    return top.join(ends[0], "o").join(ends[1], "s").withColumnsRenamed({"o": "origin", "s": "state"})


_SEIZED = {"type": "p_type", "method": "p_brand", "conveyance": "l_linestatus", "month": "month"}
_SEIZED_SQL = "z AS (SELECT p_type, p_brand, l_linestatus, strftime(l_shipdate, '%Y-%m') AS month, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R')"


@query(f"WITH {_SEIZED_SQL} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {c} AS value, count(*) AS n, coalesce(sum(q), 0)::BIGINT AS total, coalesce(min(q), 0) AS lo, coalesce(max(q), 0) AS hi, round(coalesce(avg(q), 0), 6) AS mean FROM z GROUP BY {c}" for d, c in _SEIZED.items()))
def seizures_by(spark, sf):
    """By type, method, conveyance and month; quantities that are no numbers are skipped, and none at all is 0."""
    rows = table(spark, sf, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    text = F.when(F.col("l_orderkey") % 17 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in _SEIZED.items()])).alias("x")
    q = F.col("q")
    numbers = [F.coalesce(f, F.lit(0)) for f in (F.sum(q).cast("bigint"), F.min(q), F.max(q), F.avg(q))]
    found = rows.select(cells, text.try_cast("double").alias("q")).groupBy("x.dimension", "x.value")
    return found.agg(_n(), numbers[0].alias("total"), numbers[1].alias("lo"), numbers[2].alias("hi"), F.round(numbers[3], 6).alias("mean"))


_ARRESTED = {"reason": "event_type", "charge": "charge", "disposition": "disposition", "month": "month"}


@query(f"WITH {CE}, z AS (SELECT event_type, 'charge ' || k % 5 AS charge, CASE WHEN label_available >= TIMESTAMP '2024-01-22' THEN 'open' ELSE 'closed' END AS disposition, strftime(t, '%Y-%m') AS month FROM ce WHERE arrest) " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {c} AS value, count(*) AS n FROM z GROUP BY {c}" for d, c in _ARRESTED.items()))
def arrests_by(spark, sf):
    disposition = F.when(F.col("label_available") >= F.lit("2024-01-22").cast("timestamp"), "open").otherwise("closed")
    rows = crossing_events(spark, sf).where("arrest").select("event_type", F.concat(F.lit("charge "), F.col("k") % 5).alias("charge"), disposition.alias("disposition"), F.date_format("t", "yyyy-MM").alias("month"))
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in _ARRESTED.items()])).alias("x")
    return rows.select(cells).groupBy("x.dimension", "x.value").agg(_n())


_DIMS = {"region": "r_name", "office": "n_name", "category": "o_orderpriority", "mode": "o_orderstatus", "citizenship": "left(n_name, 1)", "direction": "CASE WHEN o_orderkey % 2 = 0 THEN 'in' ELSE 'out' END", "segment": "c_mktsegment", "kind": "CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END", "month": "left(CAST(o_orderdate AS VARCHAR), 7)"}


@query(f"WITH f AS (SELECT {', '.join(f'{c} AS {d}' for d, c in _DIMS.items())}, o_totalprice FROM {_OC}) " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS secondary, count(*) FILTER (o_totalprice > 250000) AS seizure, round(count(*) FILTER (o_totalprice > 250000) / count(*), 9) AS rate FROM f GROUP BY {d}" for d in _DIMS))
def outcome_cells(spark, sf):
    """All nine dimensions; rows are counted by (dimension, value) in the map tasks."""
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.expr(c.replace("VARCHAR", "STRING")).alias("value")) for d, c in _DIMS.items()])).alias("x")
    counts = order_facts(spark, sf).select(cells, "o_totalprice").groupBy("x.dimension", "x.value").agg(_n(), F.count_if(F.col("o_totalprice") > 150000).alias("secondary"), F.count_if(F.col("o_totalprice") > 250000).alias("seizure"))
    return counts.withColumn("rate", F.round(F.col("seizure") / F.col("n"), 9))


_MEMBERS = "m AS (SELECT c_custkey AS person, c_nationkey * 10 + c_custkey % 10 AS community, c_mktsegment AS kind, c_acctbal AS score, n_name AS office, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


def _members(spark, sf):
    """person, community, kind, score, office, region."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("c_custkey").alias("person"), (F.col("c_nationkey") * 10 + F.col("c_custkey") % 10).alias("community"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("score"), F.col("n_name").alias("office"), F.col("r_name").alias("region"))


@query(f"WITH {_MEMBERS}, c AS (SELECT community, count(*) AS members, round(avg(score), 4) AS mean_score, count(*) FILTER (score < 0) AS in_debt, min(region) AS home FROM m GROUP BY 1) SELECT *, row_number() OVER (ORDER BY members DESC, community) AS rk FROM c ORDER BY members DESC, community LIMIT 30")
def community_catalogue(spark, sf):
    counts = _members(spark, sf).groupBy("community").agg(F.count(F.lit(1)).alias("members"), F.round(F.avg("score"), 4).alias("mean_score"), F.count_if(F.col("score") < 0).alias("in_debt"), F.min("region").alias("home"))
    order = [F.col("members").desc(), "community"]
    return counts.orderBy(*order).limit(30).withColumn("rk", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))


@query(f"WITH {_MEMBERS}, r AS (SELECT kind, score, row_number() OVER (PARTITION BY kind ORDER BY score, person) AS rk FROM m) SELECT kind, count(*) AS shown, min(score) AS lo, max(score) AS hi, round(sum(score), 2) AS total FROM r WHERE rk <= 200 GROUP BY kind")
def first_scores_by_kind(spark, sf):
    """The 200 smallest scores of each kind, summed up."""
    ranked = _members(spark, sf).withColumn("rk", F.row_number().over(W.partitionBy("kind").orderBy("score", "person"))).where("rk <= 200")
    return ranked.groupBy("kind").agg(F.count(F.lit(1)).alias("shown"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.round(F.sum("score"), 2).alias("total"))


@query(f"WITH {_MEMBERS} SELECT 'region' AS level, region AS place, kind, count(DISTINCT community) AS communities, count(DISTINCT person) AS people FROM m GROUP BY region, kind UNION ALL SELECT 'office', office, kind, count(DISTINCT community), count(DISTINCT person) FROM m GROUP BY office, kind")
def communities_by_place(spark, sf):
    places = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.col(level).alias("place")) for level in ("region", "office")])).alias("x")
    return _members(spark, sf).select(places, "kind", "community", "person").groupBy("x.level", "x.place", "kind").agg(F.count_distinct("community").alias("communities"), F.count_distinct("person").alias("people"))


_SEEN = f"{_MEMBERS}, s AS (SELECT n_name AS state, o_custkey AS person, o_orderpriority AS port FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"


@query(f"""WITH {_SEEN}, v AS (SELECT DISTINCT state, community, score_c FROM s JOIN m USING (person) JOIN (SELECT community, avg(score) AS score_c FROM m GROUP BY 1) USING (community)),
 t AS (SELECT state, count(DISTINCT person) AS travellers FROM s GROUP BY 1), h AS (SELECT office AS state, count(*) AS residents FROM m GROUP BY 1),
 p AS (SELECT state, port, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, port) AS rk FROM s GROUP BY state, port),
 k AS (SELECT state, community, row_number() OVER (PARTITION BY state ORDER BY score_c DESC, community) AS rk FROM v)
 SELECT state, count(*) AS communities, round(avg(score_c), 4) AS mean_score, any_value(travellers) AS travellers, any_value(residents) AS residents, greatest(0, any_value(travellers) - any_value(residents)) AS visitors,
 (SELECT string_agg(port, ', ' ORDER BY rk) FROM p WHERE p.state = v.state AND rk <= 5) AS top_ports, (SELECT string_agg(community::VARCHAR, ' ' ORDER BY rk) FROM k WHERE k.state = v.state AND rk <= 25) AS top_communities FROM v JOIN t USING (state) JOIN h USING (state) GROUP BY v.state""")
def state_communities(spark, sf):
    """Communities seen in each state, the 25 of the highest scores, residents, visitors and the five busiest ports."""
    items, o, sup, n = (table(spark, sf, t) for t in ("lineitem", "orders", "supplier", "nation"))
    seen = items.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("state"), F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("port"))
    members = _members(spark, sf)
    scores = members.groupBy("community").agg(F.avg("score").alias("score_c"))
    people = seen.select("state", "person").distinct()
    visited = people.join(members.select("person", "community"), "person").select("state", "community").distinct().join(scores, "community")

    def ranked(rows, order, value, most, out):
        kept = rows.withColumn("rk", F.row_number().over(W.partitionBy("state").orderBy(*order))).where(F.col("rk") <= most)
        listed = F.array_sort(F.collect_list(F.struct("rk", F.col(value).cast("string").alias("v"))))
        return kept.groupBy("state").agg(F.array_join(F.transform(listed, lambda x: x["v"]), ", " if most == 5 else " ").alias(out))

    ports = ranked(seen.groupBy("state", "port").agg(_n()), [F.col("n").desc(), "port"], "port", 5, "top_ports")
    best = ranked(visited, [F.col("score_c").desc(), "community"], "community", 25, "top_communities")
    totals = visited.groupBy("state").agg(F.count(F.lit(1)).alias("communities"), F.round(F.avg("score_c"), 4).alias("mean_score"))
    travellers = people.groupBy("state").agg(F.count(F.lit(1)).alias("travellers"))
    residents = members.groupBy(F.col("office").alias("state")).agg(F.count(F.lit(1)).alias("residents"))
    out = totals.join(travellers, "state").join(residents, "state").withColumn("visitors", F.greatest(F.lit(0), F.col("travellers") - F.col("residents")))
    return out.join(ports, "state").join(best, "state")


@query(f"WITH {_MEMBERS}, a AS (SELECT DISTINCT o_custkey AS person FROM orders WHERE o_totalprice > 300000) SELECT office AS state, count(*) AS residents, count(*) FILTER (score < 0) AS smugglers, count(a.person) AS arrested FROM m LEFT JOIN a USING (person) GROUP BY office")
def state_residents(spark, sf):
    arrested = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("person")).distinct().withColumn("hit", F.lit(True))
    rows = _members(spark, sf).join(arrested, "person", "left")
    return rows.groupBy(F.col("office").alias("state")).agg(F.count(F.lit(1)).alias("residents"), F.count_if(F.col("score") < 0).alias("smugglers"), F.count("hit").alias("arrested"))


#: The typed edges of the corpus checks: kind, node types, text of the ends.
TYPED = """typed AS (SELECT 'ORDERED_BY' AS edge_type, 'order' AS source_type, l_orderkey AS source, 'customer' AS target_type, o_custkey AS target, l_linenumber, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey
 UNION ALL SELECT 'SEIZED_FROM', 'order', l_orderkey, 'supplier', l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'
 UNION ALL SELECT 'KNOWS', 'supplier', l_suppkey, 'part', CASE WHEN l_orderkey % 101 = 0 THEN -l_partkey - 1 ELSE l_partkey END, l_linenumber, l_returnflag FROM lineitem)"""


def typed_edges(spark, sf):
    """edge_type, source_type, source, target_type, target, l_linenumber, l_returnflag."""
    items, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    rest = ["l_linenumber", "l_returnflag"]

    def typed(rows, kind, a, x, b, y):
        return rows.select(F.lit(kind).alias("edge_type"), F.lit(a).alias("source_type"), x.alias("source"), F.lit(b).alias("target_type"), y.alias("target"), *rest)

    part = F.when(F.col("l_orderkey") % 101 == 0, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey"))
    one = typed(items.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "ORDERED_BY", "order", F.col("l_orderkey"), "customer", F.col("o_custkey"))
    two = typed(items.where("l_returnflag = 'R'"), "SEIZED_FROM", "order", F.col("l_orderkey"), "supplier", F.col("l_suppkey"))
    return one.unionByName(two).unionByName(typed(items, "KNOWS", "supplier", F.col("l_suppkey"), "part", part))


_CATEGORY = "CASE WHEN edge_type = 'SEIZED_FROM' THEN 'outcome' WHEN edge_type = 'KNOWS' THEN 'social' ELSE 'structural' END"


@query(f"WITH {TYPED} SELECT 'edge' AS what, edge_type AS value, {_CATEGORY} AS category, count(*) AS n FROM typed GROUP BY 2, 3 UNION ALL SELECT 'node', t, NULL, count(DISTINCT id) FROM (SELECT source_type AS t, source AS id FROM typed UNION ALL SELECT target_type, target FROM typed) GROUP BY t")
def edge_and_node_counts(spark, sf):
    e = typed_edges(spark, sf)
    kinds = e.groupBy("edge_type").agg(_n()).select(F.lit("edge").alias("what"), F.col("edge_type").alias("value"), parse.edge_category(F.col("edge_type"), {"SEIZED_FROM"}, {"KNOWS"}).alias("category"), "n")
    ends = e.select(F.col("source_type").alias("value"), F.col("source").alias("id")).union(e.select("target_type", "target")).distinct()
    return kinds.unionByName(ends.groupBy("value").agg(_n()).select(F.lit("node").alias("what"), "value", F.lit(None).cast("string").alias("category"), "n"))


_COUNTERS = {"segment": ("customer", "c_mktsegment", 1000), "citizenship": ("customer", "c_nationkey", 15), "age": ("part", "p_size", 1000), "vehicle": ("part", "p_brand", 10), "document": ("documents", "source", 1000)}


@query(" UNION ALL ".join(f"(SELECT '{name}' AS counter, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} GROUP BY 2 ORDER BY n DESC, value LIMIT {most})" for name, (t, c, most) in _COUNTERS.items()))
def entity_counters(spark, sf):
    out = None
    for name, (source, column, most) in _COUNTERS.items():
        part = table(spark, sf, source).groupBy(F.col(column).cast("string").alias("value")).agg(_n()).orderBy(F.col("n").desc(), "value").limit(most).select(F.lit(name).alias("counter"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_MEMBERS}, x AS (SELECT * FROM m WHERE person % 3 = 0) SELECT community, count(*) AS sampled, count(*) FILTER (score < 0) AS flagged, round(max(score), 6) AS best FROM x GROUP BY community ORDER BY flagged DESC, sampled DESC, community LIMIT 400")
def community_presence(spark, sf):
    counts = _members(spark, sf).where("person % 3 = 0").groupBy("community").agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("score") < 0).alias("flagged"), F.round(F.max("score"), 6).alias("best"))
    return counts.orderBy(F.col("flagged").desc(), F.col("sampled").desc(), "community").limit(400)


@query(f"""WITH {CE}, p AS (SELECT identity, max(score_b) AS best, bool_or(hidden) AS carried FROM ce GROUP BY 1) SELECT identity, round(best, 9) AS best, CASE WHEN best >= 0.62 AND carried THEN 'tp' WHEN best >= 0.62 THEN 'fp' WHEN carried THEN 'fn' ELSE 'tn' END AS status FROM p ORDER BY p.best DESC, identity LIMIT 50""")
def top_people(spark, sf):
    people = crossing_events(spark, sf).groupBy("identity").agg(F.max("score_b").alias("best"), F.bool_or("hidden").alias("carried"))
    hit = F.col("best") >= 0.62
    status = F.when(hit & F.col("carried"), "tp").when(hit, "fp").when(F.col("carried"), "fn").otherwise("tn")
    return people.orderBy(F.col("best").desc(), "identity").limit(50).select("identity", F.round("best", 9).alias("best"), status.alias("status"))


#: Kinds of cliques over suppliers: bit and key.
_CLIQUES = {1: "s_nationkey", 2: "CAST(floor(s_acctbal / 100) AS INTEGER)", 4: "s_suppkey % 40", 8: "s_nationkey * 4 + s_suppkey % 4"}
_CLIQUE_SQL = f"g AS ({' UNION ALL '.join(f'SELECT {bit} AS bit, {key} AS grp, s_suppkey AS member FROM supplier' for bit, key in _CLIQUES.items())}), z AS (SELECT bit, grp FROM g GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 12), clique AS (SELECT x.member AS a, y.member AS b, bit_or(x.bit)::INT AS bits, count(*) AS w FROM g x JOIN z USING (bit, grp) JOIN g y ON y.bit = x.bit AND y.grp = x.grp AND x.member < y.member GROUP BY 1, 2)"


def _cliques(spark, sf):
    kinds = F.explode(F.array(*[F.struct(F.lit(bit).alias("bit"), F.expr(key).cast("bigint").alias("grp")) for bit, key in _CLIQUES.items()])).alias("x")
    return ties.cliques(table(spark, sf, "supplier").select(kinds, F.col("s_suppkey").alias("member")).select("x.bit", "x.grp", "member"))


@query(f"WITH {_CLIQUE_SQL} SELECT * FROM clique")
def tie_cliques(spark, sf):
    return _cliques(spark, sf)


_PARTY = "h AS (SELECT identity, strftime(day, '%Y-%m-%d') || event_type AS party, min(event_id) AS first_id FROM ce GROUP BY 1, 2), o AS (SELECT identity, party, row_number() OVER (PARTITION BY party ORDER BY first_id) AS place FROM h)"


@query(f"WITH {CE}, {_PARTY} SELECT least(x.identity, y.identity) AS a, greatest(x.identity, y.identity) AS b, count(*) AS n FROM o x JOIN o y ON x.party = y.party AND x.place < y.place AND y.place <= 12 GROUP BY 1, 2")
def party_pairs(spark, sf):
    """Pairs among the first twelve members of each party."""
    ce = crossing_events(spark, sf)
    members = ce.groupBy("identity", F.concat(F.date_format("day", "yyyy-MM-dd"), "event_type").alias("party")).agg(F.min("event_id").alias("first_id"))
    return ties.party_pairs(members, "party", "identity", "first_id", 12)


_TIES = "ends AS (SELECT a AS node, b AS other, bits, w FROM clique UNION ALL SELECT b, a, bits, w FROM clique)"


@query(f"WITH {_CLIQUE_SQL}, {_TIES}, f AS (SELECT s_suppkey AS other, s_acctbal < 0 AS smuggler, s_suppkey % 9 = 0 AS arrested FROM supplier) SELECT node, bool_or(smuggler) AS near_smuggler, bool_or(arrested) AS near_arrested, count(*) AS degree FROM ends JOIN f USING (other) GROUP BY node")
def neighbour_roles(spark, sf):
    flags = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("other"), (F.col("s_acctbal") < 0).alias("smuggler"), (F.col("s_suppkey") % 9 == 0).alias("arrested"))
    return ties.both_ways(_cliques(spark, sf)).join(flags, "other").groupBy("node").agg(F.bool_or("smuggler").alias("near_smuggler"), F.bool_or("arrested").alias("near_arrested"), F.count(F.lit(1)).alias("degree"))


@query(f"WITH {_CLIQUE_SQL}, {_TIES}, d AS (SELECT node, count(*) AS degree FROM ends GROUP BY 1) SELECT degree, count(*) AS nodes FROM d GROUP BY degree")
def degree_distribution(spark, sf):
    degrees = ties.both_ways(_cliques(spark, sf)).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"WITH {_CLIQUE_SQL}, {_TIES}, t AS (SELECT min(node) AS node FROM ends), b AS (SELECT unnest([1, 2, 4, 8])::INT AS bit) SELECT bit, count(*) AS n, sum(w)::BIGINT AS w FROM ends JOIN t USING (node), b WHERE bits & bit <> 0 GROUP BY bit")
def ego_tie_types(spark, sf):
    every = ties.both_ways(_cliques(spark, sf))
    ego = every.join(F.broadcast(every.agg(F.min("node").alias("node"))), "node")
    bits = ego.withColumn("bit", F.explode(F.array(*map(F.lit, (1, 2, 4, 8))))).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return bits.groupBy("bit").agg(_n(), F.sum("w").alias("w"))


_SAMPLE_CAPS = {"role": 40, "near": 30, "context": 5}


@query(f"""WITH {_CLIQUE_SQL}, {_TIES}, k AS (SELECT s_suppkey AS node, s_nationkey AS stratum, s_acctbal < 0 AS detected, s_suppkey % 4 = 1 AS role FROM supplier),
 seeds AS (SELECT node FROM k WHERE detected), roles AS (SELECT node FROM k WHERE role AND NOT detected ORDER BY md5(node::VARCHAR), node LIMIT {_SAMPLE_CAPS['role']}),
 n1 AS (SELECT node, other, w, row_number() OVER (PARTITION BY node ORDER BY w DESC, other) AS rk FROM ends WHERE node IN (SELECT node FROM seeds)),
 near AS (SELECT other AS node FROM n1 WHERE rk <= 5 AND other NOT IN (SELECT node FROM seeds) AND other NOT IN (SELECT node FROM roles) GROUP BY other ORDER BY max(w) DESC, other LIMIT {_SAMPLE_CAPS['near']}),
 taken AS (SELECT node, 'detected' AS why FROM seeds UNION ALL SELECT node, 'role' FROM roles UNION ALL SELECT node, 'near' FROM near),
 c AS (SELECT node, row_number() OVER (PARTITION BY stratum ORDER BY md5(node::VARCHAR), node) AS rk FROM k WHERE node NOT IN (SELECT node FROM taken))
 SELECT * FROM taken UNION ALL SELECT node, 'context' FROM c WHERE rk <= {_SAMPLE_CAPS['context']}""")
def node_sample_quotas(spark, sf):
    """All detected nodes, a bounded draw of nodes with a role, the strongest neighbours of the detected, and some context of each stratum."""
    k = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("stratum"), (F.col("s_acctbal") < 0).alias("detected"), (F.col("s_suppkey") % 4 == 1).alias("role"))
    return ties.sample(k, ties.both_ways(_cliques(spark, sf)), _SAMPLE_CAPS["role"], _SAMPLE_CAPS["near"], _SAMPLE_CAPS["context"])


@query(f"""WITH {_MEMBERS}, p AS (SELECT m.*, CASE WHEN score < 0 THEN 'debt' ELSE 'credit' END AS mood FROM m), pick AS (SELECT * FROM p WHERE kind IN ('BUILDING', 'MACHINERY') AND mood IN ('debt') AND region IN ('ASIA', 'EUROPE', 'AMERICA')),
 near AS (SELECT DISTINCT o2.o_custkey AS person FROM orders o1 JOIN pick ON o1.o_custkey = person JOIN orders o2 ON o2.o_orderdate = o1.o_orderdate AND o2.o_custkey <> o1.o_custkey)
 SELECT person, 'member' AS why FROM pick UNION ALL SELECT person, 'linked' FROM near WHERE person NOT IN (SELECT person FROM pick)""")
def explorer_drill(spark, sf):
    """Filters are or inside a group and and between groups; who shares an order's moment with a hit is shown beside the hits."""
    people = _members(spark, sf).withColumn("mood", F.when(F.col("score") < 0, "debt").otherwise("credit"))
    hits = parse.matches_groups(people, {"kind": ["BUILDING", "MACHINERY"], "mood": ["debt"], "region": ["ASIA", "EUROPE", "AMERICA"]}).select("person")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("person"), "o_orderdate")
    moments = o.join(hits, "person", "left_semi").select("o_orderdate").distinct()
    linked = o.join(moments, "o_orderdate", "left_semi").select("person").distinct().join(hits, "person", "left_anti")
    return hits.withColumn("why", F.lit("member")).unionByName(linked.withColumn("why", F.lit("linked")))
