"""Integrity checks: a check is a query that returns how many rows break it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.adapter import CE, crossing_events, table
from .registry import query

_FKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id")]


@query(" UNION ALL ".join(f"SELECT '{c}.{k}' AS rule, count(*) AS violations FROM {c} x WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{pk} = x.{k})" for c, k, p, pk in _FKS))
def fk_violations(spark, sf):
    out = None
    for child, key, parent, pk in _FKS:
        keys = table(spark, sf, child).select(F.col(key).alias("k")).where("k IS NOT NULL")
        lost = keys.join(table(spark, sf, parent).select(F.col(pk).alias("k")), "k", "left_anti").agg(F.lit(f"{child}.{key}").alias("rule"), F.count(F.lit(1)).alias("violations"))
        out = lost if out is None else out.unionByName(lost)
    return out


_KEYS = [("orders", "o_orderkey"), ("customer", "c_custkey"), ("events", "event_id"), ("documents", "doc_id"), ("pages", "page_id"), ("lineitem", "l_orderkey")]


@query(" UNION ALL ".join(f"SELECT '{t}.{k}' AS key, count(*) AS duplicated, (SELECT count(*) FROM {t} WHERE {k} IS NULL OR trim({k}::VARCHAR) = '') AS blank FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1)" for t, k in _KEYS))
def uniqueness(spark, sf):
    out = None
    for name, key in _KEYS:
        counts = table(spark, sf, name).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        blank = F.col("k").isNull() | (F.trim(F.col("k").cast("string")) == "")
        row = counts.agg(F.lit(f"{name}.{key}").alias("key"), F.count_if(F.col("n") > 1).alias("duplicated"), F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("blank"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {CE} SELECT count(*) FILTER (secondary) AS secondary, count(*) FILTER (searched) AS searched, count(*) FILTER (seizure) AS seized, count(*) FILTER (seizure AND NOT arrest) AS seized_without_arrest, count(*) FILTER (searched AND NOT seizure) AS searched_without_seizure, count(*) FILTER (secondary) > count(*) FILTER (searched) AND count(*) FILTER (searched) > count(*) FILTER (seizure) AS ordered FROM ce")
def funnel(spark, sf):
    s, x, z, a = (F.col(c) for c in ("secondary", "searched", "seizure", "arrest"))
    out = crossing_events(spark, sf).agg(F.count_if(s).alias("secondary"), F.count_if(x).alias("searched"), F.count_if(z).alias("seized"), F.count_if(z & ~a).alias("seized_without_arrest"), F.count_if(x & ~z).alias("searched_without_seizure"))
    return out.withColumn("ordered", (F.col("secondary") > F.col("searched")) & (F.col("searched") > F.col("seized")))


@query("""WITH m AS (SELECT s_suppkey, s_nationkey AS org FROM supplier), o AS (SELECT l_orderkey, org, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN m ON s_suppkey = l_suppkey GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2),
 seen AS (SELECT DISTINCT org FROM o) SELECT m.org, count(*) AS members, bool_or(seen.org IS NOT NULL) AS observable FROM m LEFT JOIN seen ON seen.org = m.org GROUP BY m.org""")
def observable_recompute(spark, sf):
    members = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("org"))
    together = table(spark, sf, "lineitem").join(members, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "org").agg(F.count_distinct("l_suppkey").alias("n")).where("n >= 2")
    seen = together.select("org").distinct().withColumn("hit", F.lit(True))
    return members.join(seen, "org", "left").groupBy("org").agg(F.count(F.lit(1)).alias("members"), F.bool_or(F.coalesce("hit", F.lit(False))).alias("observable"))


@query(f"WITH {CE} SELECT max(t) FILTER (split = 'train') < min(t) FILTER (split = 'validation') AND max(t) FILTER (split = 'validation') < min(t) FILTER (split = 'test') AS ordered, count(*) FILTER (label_available < t) AS label_before_event FROM ce")
def temporal_order(spark, sf):
    def at(f, split):
        return f(F.when(F.col("split") == split, F.col("t")))

    return crossing_events(spark, sf).agg(((at(F.max, "train") < at(F.min, "validation")) & (at(F.max, "validation") < at(F.min, "test"))).alias("ordered"), F.count_if(F.col("label_available") < F.col("t")).alias("label_before_event"))


@query("SELECT s_nationkey AS family, count(DISTINCT s_suppkey % 7) AS households, count(DISTINCT s_suppkey % 7) >= 2 AS spans FROM supplier GROUP BY 1")
def family_spans(spark, sf):
    out = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("family")).agg(F.count_distinct(F.col("s_suppkey") % 7).alias("households"))
    return out.withColumn("spans", F.col("households") >= 2)


@query("SELECT count(*) AS lines, count(*) FILTER (contains(lower(line), 'the')) AS hits FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)")
def text_leak_scan(spark, sf):
    lines = table(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.lower("line").contains("the")).alias("hits"))


@query(f"WITH {CE}, a AS (SELECT DISTINCT identity FROM ce WHERE split = 'train'), b AS (SELECT DISTINCT identity FROM ce WHERE split = 'test') SELECT 'missing' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'unexpected', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'shared', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def set_equality(spark, sf):
    ce = crossing_events(spark, sf)
    a, b = (ce.where(F.col("split") == s).select("identity").distinct() for s in ("train", "test"))
    parts = {"missing": a.join(b, "identity", "left_anti"), "unexpected": b.join(a, "identity", "left_anti"), "shared": a.join(b, "identity", "left_semi")}
    rows = [p.agg(F.lit(n).alias("side"), F.count(F.lit(1)).alias("n")) for n, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
