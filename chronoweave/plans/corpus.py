"""Checks of the corpus: typed edges, organisations, evidence, record links, totals, columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.adapter import CE, OBS, crossing_events, observations, table
from .cube import TYPED, typed_edges
from .registry import query


def _n():
    return F.count(F.lit(1))


_NODES = {"order": ("orders", "o_orderkey"), "customer": ("customer", "c_custkey"), "supplier": ("supplier", "s_suppkey"), "part": ("part", "p_partkey")}


@query(f"""WITH {TYPED}, known AS ({' UNION ALL '.join(f"SELECT '{t}' AS node_type, {k} AS id FROM {source}" for t, (source, k) in _NODES.items())}), ends AS (SELECT edge_type, source_type AS node_type, source AS id FROM typed UNION ALL SELECT edge_type, target_type, target FROM typed)
 SELECT e.edge_type, e.node_type, count(*) AS ends, count(*) FILTER (k.id IS NULL) AS unresolved FROM ends e LEFT JOIN known k ON k.node_type = e.node_type AND k.id = e.id WHERE e.edge_type <> 'SEIZED_FROM' GROUP BY 1, 2""")
def endpoint_resolution(spark, sf):
    """Ends of typed edges that no table of their type has; edges to outcomes are exempt."""
    e = typed_edges(spark, sf).where("edge_type <> 'SEIZED_FROM'")
    ends = e.select("edge_type", F.col("source_type").alias("node_type"), F.col("source").alias("id")).union(e.select("edge_type", "target_type", "target"))
    counted = ends.groupBy("edge_type", "node_type", "id").agg(_n().alias("n"))  # before the join: a node that many edges share is one row
    known = None
    for kind, (source, key) in _NODES.items():
        part = table(spark, sf, source).select(F.lit(kind).alias("node_type"), F.col(key).alias("id"), F.lit(True).alias("known"))
        known = part if known is None else known.unionByName(part)
    joined = counted.join(known, ["node_type", "id"], "left")
    return joined.groupBy("edge_type", "node_type").agg(F.sum("n").alias("ends"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("unresolved"))


_SOURCE = "CASE WHEN edge_type = 'KNOWS' AND l_linenumber = 7 THEN 'contact list' WHEN edge_type = 'KNOWS' THEN 'association' ELSE 'record' END"
_RULES = {
    "phone_or_contact_edge": "edge_type LIKE '%PHONE%' OR evidence LIKE '%contact%'",
    "association_ends": "edge_type = 'KNOWS' AND NOT (source_type = 'supplier' AND target_type = 'part')",
    "association_evidence": "edge_type = 'KNOWS' AND evidence <> 'association'",
    "outcome_marked_safe": "edge_type = 'SEIZED_FROM' AND leakage_safe",
}


@query(f"WITH {TYPED}, x AS (SELECT *, {_SOURCE} AS evidence, l_linenumber % 3 = 0 AS leakage_safe FROM typed) " + " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER ({rule}) AS violations FROM x" for name, rule in _RULES.items()))
def edge_rules(spark, sf):
    """No edges from phones or contacts; associations between the right nodes and on the right evidence; outcome edges never marked as safe."""
    x = typed_edges(spark, sf).withColumn("evidence", F.expr(_SOURCE)).withColumn("leakage_safe", F.col("l_linenumber") % 3 == 0)
    counts = x.agg(*[F.count_if(F.expr(rule)).alias(name) for name, rule in _RULES.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in _RULES])).alias("y")).select("y.*")


_ORGS = "org AS (SELECT s_suppkey AS person, s_nationkey AS org, s_suppkey % 6 AS family, s_acctbal < 0 AS dark FROM supplier)"


def _orgs(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person"), F.col("s_nationkey").alias("org"), (F.col("s_suppkey") % 6).alias("family"), (F.col("s_acctbal") < 0).alias("dark"))


@query(f"WITH {_ORGS}, g AS (SELECT org, count(*) AS members, count(DISTINCT family) AS families, count(*) FILTER (dark) AS dark FROM org GROUP BY 1) SELECT count(*) AS orgs, count(*) FILTER (families >= 2) AS cross_family, count(*) FILTER (dark > 0) AS with_dark, sum(dark)::BIGINT AS dark_members, max(members) AS largest FROM g")
def organisations(spark, sf):
    """Organisations exist, span families and have dark members."""
    g = _orgs(spark, sf).groupBy("org").agg(_n().alias("members"), F.count_distinct("family").alias("families"), F.count_if("dark").alias("dark"))
    return g.agg(_n().alias("orgs"), F.count_if(F.col("families") >= 2).alias("cross_family"), F.count_if(F.col("dark") > 0).alias("with_dark"), F.sum("dark").alias("dark_members"), F.max("members").alias("largest"))


@query(f"""WITH {_ORGS}, seen AS (SELECT l_suppkey AS person, l_orderkey AS event_id, CASE WHEN l_returnflag = 'R' THEN l_partkey END AS vehicle FROM lineitem),
 a AS (SELECT org FROM seen JOIN org USING (person) GROUP BY event_id, org HAVING count(DISTINCT person) >= 2), b AS (SELECT org FROM seen JOIN org USING (person) WHERE vehicle IS NOT NULL GROUP BY vehicle, org HAVING count(DISTINCT person) >= 2),
 d AS (SELECT DISTINCT org, org % 4 <> 3 AS declared FROM org), r AS (SELECT org, declared, org IN (SELECT org FROM a) AS by_event, org IN (SELECT org FROM b) AS by_vehicle FROM d) SELECT org, declared, by_event, by_vehicle, declared = (by_event OR by_vehicle) AS consistent FROM r""")
def observable_evidence(spark, sf):
    """What is declared observable against both kinds of evidence: members together at an event, or on one vehicle."""
    org = _orgs(spark, sf).select("person", "org")
    seen = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("event_id"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("vehicle")).join(org, "person")

    def together(rows, key, out):
        return rows.groupBy(key, "org").agg(F.count_distinct("person").alias("n")).where("n >= 2").select("org").distinct().withColumn(out, F.lit(True))

    declared = org.select("org", (F.col("org") % 4 != 3).alias("declared")).distinct()
    both = declared.join(together(seen, "event_id", "by_event"), "org", "left").join(together(seen.where("vehicle IS NOT NULL"), "vehicle", "by_vehicle"), "org", "left").fillna(False)
    return both.select("org", "declared", "by_event", "by_vehicle", (F.col("declared") == (F.col("by_event") | F.col("by_vehicle"))).alias("consistent"))


_LINKS = """recs AS (SELECT event_id AS record, identity AS person FROM ce WHERE event_id % 29 <> 0),
 links AS (SELECT event_id AS a, event_id + 3 AS b, event_id % 5 = 0 AS declared_same, score_a > 0.9 AS deterministic, score_a BETWEEN 0.5 AND 0.7 AS weak FROM ce WHERE event_id % 4 = 0)"""


@query(f"""WITH {CE}, {_LINKS}, j AS (SELECT l.*, x.person AS pa, y.person AS pb FROM links l LEFT JOIN recs x ON x.record = l.a LEFT JOIN recs y ON y.record = l.b)
 SELECT count(*) AS links, count(*) FILTER (pa IS NULL OR pb IS NULL) AS unresolved, count(*) FILTER (pa = pb) AS same_person, count(*) FILTER (pa IS NOT NULL AND pb IS NOT NULL AND declared_same <> (pa = pb)) AS inconsistent, count(*) FILTER (deterministic) AS deterministic, count(*) FILTER (weak) AS weak, count(*) FILTER (weak AND coalesce(pa = pb, false)) AS weak_positive FROM j""")
def record_links(spark, sf):
    """Pairs of records: both ends known, the declared truth equal to the one looked up, both kinds of link present."""
    ce = crossing_events(spark, sf)
    recs = ce.where("event_id % 29 <> 0").select(F.col("event_id").alias("record"), F.col("identity").alias("person"))
    links = ce.where("event_id % 4 = 0").select(F.col("event_id").alias("a"), (F.col("event_id") + 3).alias("b"), (F.col("event_id") % 5 == 0).alias("declared_same"), (F.col("score_a") > 0.9).alias("deterministic"), F.col("score_a").between(0.5, 0.7).alias("weak"))
    j = links.join(recs.toDF("a", "pa"), "a", "left").join(recs.toDF("b", "pb"), "b", "left")
    same, known = F.coalesce(F.col("pa") == F.col("pb"), F.lit(False)), F.col("pa").isNotNull() & F.col("pb").isNotNull()
    return j.agg(_n().alias("links"), F.count_if(~known).alias("unresolved"), F.count_if(same).alias("same_person"), F.count_if(known & (F.col("declared_same") != same)).alias("inconsistent"), F.count_if("deterministic").alias("deterministic"), F.count_if("weak").alias("weak"), F.count_if(F.col("weak") & same).alias("weak_positive"))


@query(f"""WITH {CE}, recs AS (SELECT event_id AS record FROM ce WHERE event_id % 29 <> 0), t AS (SELECT 'truth' AS source, event_id AS record, identity AS cluster FROM ce WHERE event_id % 3 = 0 UNION ALL SELECT 'baseline', event_id, 'B' || k FROM ce WHERE event_id % 3 <> 1 UNION ALL SELECT 'oracle', event_id, identity FROM ce)
 SELECT source, count(*) AS rows_, count(DISTINCT cluster) AS clusters, count(*) FILTER (record NOT IN (SELECT record FROM recs)) AS unresolved FROM t GROUP BY source""")
def cluster_tables(spark, sf):
    """Every row of the three cluster tables names a known record."""
    ce = crossing_events(spark, sf)
    recs = ce.where("event_id % 29 <> 0").select(F.col("event_id").alias("record"), F.lit(True).alias("known"))
    parts = [("truth", "event_id % 3 = 0", F.col("identity")), ("baseline", "event_id % 3 <> 1", F.concat(F.lit("B"), "k")), ("oracle", "true", F.col("identity"))]
    rows = None
    for name, rule, cluster in parts:
        part = ce.where(rule).select(F.lit(name).alias("source"), F.col("event_id").alias("record"), cluster.alias("cluster"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(recs, "record", "left").groupBy("source").agg(_n().alias("rows_"), F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("known").isNull()).alias("unresolved"))


_TOTALS = {"orders": "orders", "lineitem": "lineitem", "customer": "customer", "supplier": "supplier", "events": "events"}


@query("WITH said AS (SELECT 'orders' AS name, count(DISTINCT l_orderkey) AS declared FROM lineitem UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', max(c_custkey) + 1 FROM customer UNION ALL SELECT 'supplier', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'events', max(event_id) + 1 FROM events), is_ AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS counted FROM {t}" for n, t in _TOTALS.items()) + ") SELECT name, declared, counted, declared = counted AS agrees FROM said JOIN is_ USING (name)")
def summary_totals(spark, sf):
    """Totals that a summary declares against the tables' own counts."""
    items = table(spark, sf, "lineitem")
    said = [items.agg(F.lit("orders").alias("name"), F.count_distinct("l_orderkey").alias("declared")), items.agg(F.lit("lineitem").alias("name"), _n().alias("declared")), table(spark, sf, "customer").agg(F.lit("customer").alias("name"), (F.max("c_custkey") + 1).alias("declared")), items.agg(F.lit("supplier").alias("name"), F.count_distinct("l_suppkey").alias("declared")), table(spark, sf, "events").agg(F.lit("events").alias("name"), (F.max("event_id") + 1).alias("declared"))]
    counted = [table(spark, sf, t).agg(F.lit(n).alias("name"), _n().alias("counted")) for n, t in _TOTALS.items()]
    for parts in (said, counted):
        for part in parts[1:]:
            parts[0] = parts[0].unionByName(part)
    return said[0].join(counted[0], "name").withColumn("agrees", F.col("declared") == F.col("counted"))


_COLUMNS = [("supplier", "s_name", True), ("supplier", "s_phone", False), ("customer", "c_acctbal", True), ("customer", "c_address", False), ("events", "props", True)]


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS rule, (CASE WHEN (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}' AND column_name = '{c}') = {int(wanted)} THEN 0 ELSE 1 END)::BIGINT AS violations" for t, c, wanted in _COLUMNS) + " UNION ALL SELECT 'prefix of s_name', count(*) FILTER (NOT starts_with(s_name, 'Supplier#')) FROM supplier UNION ALL SELECT 'prefix of c_name', count(*) FILTER (NOT starts_with(c_name, 'Customer#')) FROM customer")
def column_rules(spark, sf):
    """Columns that must be there or must not, and names that carry the synthetic prefix."""
    rows = [(f"{t}.{c}", int((c in table(spark, sf, t).columns) != wanted)) for t, c, wanted in _COLUMNS]
    out = spark.createDataFrame(rows, "rule string, violations long")
    for source, column, prefix in (("supplier", "s_name", "Supplier#"), ("customer", "c_name", "Customer#")):
        out = out.unionByName(table(spark, sf, source).agg(F.lit(f"prefix of {column}").alias("rule"), F.count_if(~F.col(column).startswith(prefix)).alias("violations")))
    return out


@query(f"""WITH {OBS}, p AS (SELECT a.identity AS u, b.identity AS v, greatest(a.t, b.t) AS met FROM obs a JOIN obs b ON a.event_id = b.event_id AND a.identity < b.identity), f AS (SELECT u, v, min(met) AS first_t, max(met) AS last_t, count(*) AS times FROM p GROUP BY 1, 2)
 SELECT strftime(first_t, '%Y') AS year, count(*) AS pairs, sum(times)::BIGINT AS times, count(*) FILTER (last_t > first_t) AS met_again FROM f GROUP BY 1""")
def first_shared_crossing(spark, sf):
    """Each pair's edge carries the time of the first event that both share."""
    from ..operators import edges

    obs, _ = observations(spark, sf)
    firsts = edges.cotravel(obs, "event_id").where("u < v").groupBy("u", "v").agg(F.min("avail_time").alias("first_t"), F.max("avail_time").alias("last_t"), _n().alias("times"))
    return firsts.groupBy(F.date_format("first_t", "yyyy").alias("year")).agg(_n().alias("pairs"), F.sum("times").alias("times"), F.count_if(F.col("last_t") > F.col("first_t")).alias("met_again"))


@query(f"""WITH {CE}, pub AS (SELECT day, co_key, identity, t, label_available FROM ce WHERE split = 'validation') SELECT strftime(day, '%Y-%m-%d') AS day_text, count(*) AS rows_, count(*) FILTER (t >= day + INTERVAL 1 DAY) AS from_later_days, count(*) FILTER (label_available >= day + INTERVAL 1 DAY) AS labels_not_yet_known, count(DISTINCT identity) AS members FROM pub GROUP BY day""")
def community_as_of(spark, sf):
    """A published day holds nothing that was not there by its end; labels that were not are counted."""
    pub = crossing_events(spark, sf).where("split = 'validation'")
    end = F.date_add("day", 1).cast("timestamp")
    counts = pub.groupBy("day").agg(_n().alias("rows_"), F.count_if(F.col("t") >= end).alias("from_later_days"), F.count_if(F.col("label_available") >= end).alias("labels_not_yet_known"), F.count_distinct("identity").alias("members"))
    return counts.select(F.date_format("day", "yyyy-MM-dd").alias("day_text"), "rows_", "from_later_days", "labels_not_yet_known", "members")


@query(f"WITH {_ORGS} SELECT org, count(DISTINCT family) AS families, count(DISTINCT family) >= 2 AS spans FROM org GROUP BY org")
def org_spans(spark, sf):
    out = _orgs(spark, sf).groupBy("org").agg(F.count_distinct("family").alias("families"))
    return out.withColumn("spans", F.col("families") >= 2)
