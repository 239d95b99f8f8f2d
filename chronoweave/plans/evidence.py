"""Cases, orders and pages of evidence, controls and what removing edges does."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parse import logistic
from ..functions.rank import average_percentile
from ..operators import evidence, metrics, simulate
from ..sources.adapter import CE, crossing_events, table
from .ranking import SCORES, _LONG, _PCT
from .registry import query


def _n():
    return F.count(F.lit(1)).alias("n")

K = 10

_FOUND = f"{_LONG}, rk AS (SELECT *, row_number() OVER (PARTITION BY arm, day ORDER BY s DESC, row_ix) AS rk FROM l), hit AS (SELECT * FROM rk WHERE hidden AND rk <= {K}), per AS (SELECT arm, identity, min(day) AS day, min_by(row_ix, (day, rk)) AS row_ix FROM hit GROUP BY 1, 2), side AS (SELECT identity, CASE WHEN count(*) = 2 THEN 'both' WHEN min(arm) = 'score_a' THEN 'baseline_only' ELSE 'hybrid_only' END AS side FROM per GROUP BY 1)"


def _ranked(spark, sf):
    pool = crossing_events(spark, sf).where("split = 'test'")
    return metrics.daily_ranks(pool, SCORES, "identity")


def _recovered(ranked):
    """arm, identity, day and row of the first find within the daily budget."""
    hits = ranked.where(F.col("hidden") & (F.col("rk") <= K))
    first = F.min_by("row_ix", F.struct("day", "rk"))
    return hits.groupBy("arm", "identity").agg(F.min("day").alias("day"), first.alias("row_ix"))


def _sides(found):
    side = F.when(F.count(F.lit(1)) == 2, "both").when(F.min("arm") == "score_a", "baseline_only").otherwise("hybrid_only")
    return found.groupBy("identity").agg(side.alias("side"))


@query(f"WITH {CE}, {_FOUND} SELECT count(*) FILTER (side = 'both') AS both_people, count(*) FILTER (side = 'hybrid_only') AS hybrid_only, count(*) FILTER (side = 'baseline_only') AS baseline_only, count(*) FILTER (side = 'hybrid_only') - count(*) FILTER (side = 'baseline_only') AS net_gain FROM side")
def overlap_summary(spark, sf):
    side = F.col("side")
    counts = _sides(_recovered(_ranked(spark, sf))).agg(F.count_if(side == "both").alias("both_people"), F.count_if(side == "hybrid_only").alias("hybrid_only"), F.count_if(side == "baseline_only").alias("baseline_only"))
    return counts.withColumn("net_gain", F.col("hybrid_only") - F.col("baseline_only"))


_CASES = f"""{_FOUND}, base AS (SELECT row_ix, rk AS baseline_rank FROM rk WHERE arm = 'score_a'), hyb AS (SELECT row_ix, rk AS hybrid_rank FROM rk WHERE arm = 'score_b'),
 cases AS (SELECT p.identity, side, strftime(p.day, '%Y-%m-%d') AS day_text, strftime(p.day, '%Y-%m') AS period, p.row_ix, baseline_rank, hybrid_rank, baseline_rank - hybrid_rank AS uplift, (SELECT count(*) FROM ce c WHERE c.identity = p.identity AND c.day = p.day) AS same_day_rows
 FROM per p JOIN side USING (identity) JOIN base ON base.row_ix = p.row_ix JOIN hyb ON hyb.row_ix = p.row_ix WHERE side <> 'both')"""


def _cases(spark, sf):
    ranked = _ranked(spark, sf)
    found = _recovered(ranked)
    ranks = [ranked.where(F.col("arm") == arm).select("row_ix", F.col("rk").alias(out)) for arm, out in (("score_a", "baseline_rank"), ("score_b", "hybrid_rank"))]
    rows = found.join(_sides(found).where("side <> 'both'"), "identity").join(ranks[0], "row_ix").join(ranks[1], "row_ix")
    days = crossing_events(spark, sf).where("split = 'test'").groupBy("identity", "day").agg(F.count(F.lit(1)).alias("same_day_rows"))
    rows = rows.join(days, ["identity", "day"]).withColumn("uplift", F.col("baseline_rank") - F.col("hybrid_rank"))
    return rows.select("identity", "side", F.date_format("day", "yyyy-MM-dd").alias("day_text"), F.date_format("day", "yyyy-MM").alias("period"), "row_ix", "baseline_rank", "hybrid_rank", "uplift", "same_day_rows")


@query(f"WITH {CE}, {_CASES} SELECT * FROM cases")
def exclusive_cases(spark, sf):
    """People that one arm alone finds: the anchor of the find, ranks in both arms, the month, the person's rows of the day."""
    return _cases(spark, sf)


@query(f"WITH {CE}, {_CASES} SELECT identity, side, day_text, row_number() OVER (ORDER BY day_text, CASE WHEN side = 'hybrid_only' THEN 0 ELSE 1 END, identity) AS place FROM cases ORDER BY place LIMIT 500")
def case_schedule(spark, sf):
    """The first 500 cases in the order in which they are explained: day, cohort, person."""
    order = ["day_text", F.when(F.col("side") == "hybrid_only", 0).otherwise(1), "identity"]
    first = _cases(spark, sf).orderBy(*order).limit(500)
    return first.select("identity", "side", "day_text", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).alias("place"))


@query(f"WITH {CE}, {_CASES}, x AS (SELECT *, uplift > 20 AS explained FROM cases WHERE side = 'hybrid_only') SELECT identity, explained, uplift, same_day_rows, row_number() OVER (ORDER BY explained DESC, same_day_rows DESC, uplift DESC, identity, row_ix) AS place FROM x ORDER BY place LIMIT 25")
def case_list(spark, sf):
    """The first page of the filtered cases: explained first, then the chosen measure, uplift, person, case."""
    order = [F.col("explained").desc(), F.col("same_day_rows").desc(), F.col("uplift").desc(), "identity", "row_ix"]
    rows = _cases(spark, sf).where("side = 'hybrid_only'").withColumn("explained", F.col("uplift") > 20).orderBy(*order).limit(25)
    return rows.select("identity", "explained", "uplift", "same_day_rows", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).alias("place"))


@query("WITH t AS (SELECT count(*) AS n FROM customer), p AS (SELECT greatest(1, ceil(n / 40.0))::INT AS pages FROM t) SELECT c_custkey AS id, c_acctbal AS balance, (pages - 1)::INT AS page, pages FROM customer, p ORDER BY c_acctbal DESC, c_custkey LIMIT 40 OFFSET (SELECT (pages - 1) * 40 FROM p)")
def last_page(spark, sf):
    """A page number beyond the end gives the last page."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return evidence.page(rows, [F.col("balance").desc(), F.col("id")], 10**9, 40)


_ATTR = "a AS (SELECT l_orderkey AS grp, l_linenumber AS id, l_quantity AS weight, CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN 8 - l_linenumber ELSE l_linenumber // 2 END AS producer_rank FROM lineitem)"


@query(f"WITH {_ATTR}, s AS (SELECT grp, count(producer_rank) = count(*) AND count(DISTINCT producer_rank) = count(*) AS use FROM a GROUP BY 1), r AS (SELECT a.*, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN use THEN producer_rank END, CASE WHEN NOT use THEN -weight END, id) AS rk FROM a JOIN s USING (grp)) SELECT grp, id, weight, producer_rank, rk FROM r WHERE rk <= 3")
def attribution_top3(spark, sf):
    line = F.col("l_linenumber")
    rank = F.when(F.col("l_orderkey") % 3 == 0, None).when(F.col("l_orderkey") % 3 == 1, 8 - line).otherwise(F.floor(line / 2).cast("int"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"), line.alias("id"), F.col("l_quantity").alias("weight"), rank.alias("producer_rank"))
    return evidence.attribution(rows, keys=("grp",))


@query("SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem ORDER BY l_discount, -l_quantity, l_shipdate, l_orderkey, l_linenumber LIMIT 256")
def smallest_composite(spark, sf):
    """The smallest 256 rows of a composite key: a heap in each task, merged."""
    return table(spark, sf, "lineitem").orderBy("l_discount", -F.col("l_quantity"), "l_shipdate", "l_orderkey", "l_linenumber").limit(256).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))


@query(f"WITH {CE}, s AS (SELECT strftime(day, '%Y-%m-%d') AS day_text, identity, count(*) AS size FROM ce GROUP BY 1, 2) SELECT * FROM s ORDER BY size DESC, day_text, identity LIMIT 1")
def largest_case(spark, sf):
    sizes = crossing_events(spark, sf).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day_text"), "identity").agg(F.count(F.lit(1)).alias("size"))
    return sizes.orderBy(F.col("size").desc(), "day_text", "identity").limit(1)


_MASKS = """masks AS (SELECT p_brand || '/' || p_type AS factor, r AS restart, sum(CASE WHEN (l_orderkey + l_linenumber) % 3 = r THEN l_quantity ELSE 0 END) AS w FROM lineitem JOIN part ON p_partkey = l_partkey, (SELECT unnest([0, 1, 2])::BIGINT AS r) GROUP BY 1, 2),
 pk AS (SELECT *, w / greatest(max(w) OVER (PARTITION BY restart), 1e-12) AS nw, row_number() OVER (PARTITION BY restart ORDER BY w DESC, factor) AS place, count(*) OVER (PARTITION BY restart) AS factors FROM masks),
 st AS (SELECT factor, median(nw) AS mid, quantile_cont(nw, 0.25) AS q1, quantile_cont(nw, 0.75) AS q3, count(*) FILTER (place <= greatest(1, ceil(factors * 0.1::DOUBLE)) AND w > 0) / 3 AS frequency FROM pk GROUP BY 1)"""


def _masks(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    factor = F.concat("p_brand", F.lit("/"), "p_type").alias("factor")
    parts = [F.sum(F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == r, F.col("l_quantity")).otherwise(0.0)).alias(f"w{r}") for r in range(3)]
    wide = rows.groupBy(factor).agg(*parts)
    return wide.select("factor", F.explode(F.array(*[F.struct(F.lit(r).alias("restart"), F.col(f"w{r}").alias("w")) for r in range(3)])).alias("x")).select("factor", "x.restart", "x.w")


@query(f"WITH {_MASKS} SELECT factor, round(mid, 9) AS mid, round(q1, 9) AS q1, round(q3, 9) AS q3, round(frequency, 9) AS frequency, CASE WHEN length(factor) % 5 = 0 THEN 'countervailing' WHEN frequency >= 2 / 3 AND q3 - q1 <= 0.25 THEN 'stable' ELSE 'unstable' END AS status FROM st")
def factor_stability(spark, sf):
    """Median and quartiles of three normalised restarts, how often a factor is among the top tenth, and the status that follows."""
    out = evidence.restart_summary(_masks(spark, sf), "factor", "restart", "w")
    effect = F.when(F.length("factor") % 5 == 0, -1).otherwise(1)
    return out.select("factor", *[F.round(c, 9).alias(c) for c in ("mid", "q1", "q3", "frequency")], evidence.stability(effect, F.col("frequency"), F.col("q3") - F.col("q1")).alias("status"))


@query(f"WITH {_MASKS} SELECT factor, round(mid, 9) AS mid, row_number() OVER (ORDER BY mid DESC, factor) AS rk FROM st ORDER BY mid DESC, factor LIMIT 10")
def top_factors(spark, sf):
    first = evidence.restart_summary(_masks(spark, sf), "factor", "restart", "w").orderBy(F.col("mid").desc(), "factor").limit(10)
    return first.select("factor", F.round("mid", 9).alias("mid"), F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("mid").desc(), "factor")).alias("rk"))


_EDGES = """e0 AS (SELECT l_suppkey AS u, o_custkey AS v, count(*) AS n, sum(l_quantity) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
 e AS (SELECT u || '-' || v AS edge_id, u, v, u % 3 AS rel, CASE WHEN n <= 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 8 THEN '5-8' ELSE '9+' END AS degree_bin, weight FROM e0),
 r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY weight DESC, edge_id) AS place, count(*) OVER (PARTITION BY u) AS edges FROM e)"""


def _edges(spark, sf):
    """edge_id, u, v, rel, degree_bin, weight, place (by weight among u's edges), edges (of u)."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = rows.groupBy(F.col("l_suppkey").alias("u"), F.col("o_custkey").alias("v")).agg(_n(), F.sum("l_quantity").alias("weight"))
    e = e.select(F.concat("u", F.lit("-"), "v").alias("edge_id"), "u", "v", (F.col("u") % 3).alias("rel"), evidence.degree_bin(F.col("n")).alias("degree_bin"), "weight")
    own = W.partitionBy("u")
    return e.withColumn("place", F.row_number().over(own.orderBy(F.col("weight").desc(), "edge_id"))).withColumn("edges", F.count(F.lit(1)).over(own))


_CONTROLS = "sel AS (SELECT rel, degree_bin, edge_id, row_number() OVER (PARTITION BY rel, degree_bin ORDER BY edge_id) AS nth FROM r WHERE place <= 2), ctl AS (SELECT rel, degree_bin, edge_id, row_number() OVER (PARTITION BY rel, degree_bin ORDER BY md5(edge_id), edge_id) AS nth FROM r WHERE place > 2)"


@query(f"WITH {_EDGES}, {_CONTROLS} SELECT sel.edge_id AS selected_edge, ctl.edge_id AS control_edge FROM sel LEFT JOIN ctl USING (rel, degree_bin, nth)")
def matched_controls(spark, sf):
    """Each node's two heaviest edges, and for each an unused edge of the same relation and degree bin."""
    return evidence.matched_controls(_edges(spark, sf), F.col("place") <= 2)


_P = "1 / (1 + exp(-({x} / 200.0::DOUBLE - 1)))"


@query(f"""WITH {_EDGES}, f AS (SELECT unnest([10, 25, 50])::INT AS percent), c AS (SELECT u, percent, sum(weight) AS whole, sum(CASE WHEN place <= greatest(1, ceil(edges * percent / 100.0::DOUBLE)) THEN weight ELSE 0 END) AS gone, count(*) FILTER (place <= greatest(1, ceil(edges * percent / 100.0::DOUBLE))) AS removed FROM r, f GROUP BY 1, 2)
 SELECT u, percent, removed, round({_P.format(x='whole')}, 9) AS probability, round({_P.format(x='whole')} - {_P.format(x='(whole - gone)')}, 9) AS drop_ FROM c""")
def faithfulness(spark, sf):
    """How far a node's probability falls as the heaviest 10, 25 and 50 % of its edges are removed."""
    cuts = _edges(spark, sf).withColumn("percent", F.explode(F.array(*map(F.lit, (10, 25, 50)))))
    out = F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("edges") * F.col("percent") / 100.0))
    sums = cuts.groupBy("u", "percent").agg(F.sum("weight").alias("whole"), F.sum(F.when(out, F.col("weight")).otherwise(0.0)).alias("gone"), F.count_if(out).alias("removed"))
    p, q = logistic(F.col("whole") / 200.0 - 1), logistic((F.col("whole") - F.col("gone")) / 200.0 - 1)
    return sums.select("u", "percent", "removed", F.round(p, 9).alias("probability"), F.round(p - q, 9).alias("drop_"))


@query(f"WITH {_EDGES}, c AS (SELECT u, rel, sum(weight) AS own FROM e GROUP BY 1, 2), t AS (SELECT u, sum(weight) AS whole FROM e GROUP BY 1), k AS (SELECT u, degree_bin, sum(weight) AS own FROM e GROUP BY 1, 2) SELECT u, degree_bin, round({_P.format(x='(whole - own)')}, 9) AS without, round({_P.format(x='own')}, 9) AS alone FROM k JOIN t USING (u)")
def edge_set_probe(spark, sf):
    """The probability without a set of edges, and with that set alone, for each node and degree bin."""
    e = _edges(spark, sf)
    whole = e.groupBy("u").agg(F.sum("weight").alias("whole"))
    own = e.groupBy("u", "degree_bin").agg(F.sum("weight").alias("own")).join(whole, "u")
    return own.select("u", "degree_bin", F.round(logistic((F.col("whole") - F.col("own")) / 200.0 - 1), 9).alias("without"), F.round(logistic(F.col("own") / 200.0 - 1), 9).alias("alone"))


@query(f"WITH {_EDGES}, inside AS (SELECT s_suppkey AS u FROM supplier WHERE s_nationkey = 3), m AS (SELECT DISTINCT v FROM e WHERE u IN (SELECT u FROM inside)) SELECT v, count(*) AS edges, round(sum(weight), 6) AS weight, count(DISTINCT u) AS outsiders FROM e WHERE v IN (SELECT v FROM m) AND u NOT IN (SELECT u FROM inside) GROUP BY v")
def outside_provenance(spark, sf):
    """Edges that lead from a community's neighbours out of it, by neighbour."""
    e = _edges(spark, sf)
    inside = table(spark, sf, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("u"))
    near = e.join(inside, "u", "left_semi").select("v").distinct()
    return e.join(near, "v", "left_semi").join(inside, "u", "left_anti").groupBy("v").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 6).alias("weight"), F.count_distinct("u").alias("outsiders"))


_STAGES = {"first_hop": "hop <= 1", "second_hop": "hop <= 2", "component_pool": "rel = 0 AND pooled", "rank_fusion": "false"}


@query(f"WITH {_EDGES}, h AS (SELECT rel, CASE WHEN u % 10 = 0 THEN 1 WHEN u % 10 < 5 THEN 2 ELSE 3 END AS hop, u % 4 = 0 AS pooled FROM e) " + " UNION ALL ".join(f"SELECT '{name}' AS stage, count(*) FILTER ({rule}) AS edges FROM h" for name, rule in _STAGES.items()))
def flow_stages(spark, sf):
    """How many edges each stage of the flow shows."""
    hop = F.when(F.col("u") % 10 == 0, 1).when(F.col("u") % 10 < 5, 2).otherwise(3)
    rows = _edges(spark, sf).select("rel", hop.alias("hop"), (F.col("u") % 4 == 0).alias("pooled"))
    counts = rows.agg(*[F.count_if(F.expr(rule)).alias(name) for name, rule in _STAGES.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("stage"), F.col(name).alias("edges")) for name in _STAGES])).alias("x")).select("x.*")


@query("WITH x AS (SELECT l_suppkey AS node, s_nationkey AS home, l_returnflag AS flag, l_shipdate AS seen FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), c AS (SELECT node, count(DISTINCT home) AS home, count(DISTINCT flag) AS flag, count(DISTINCT seen) AS seen FROM x GROUP BY 1) " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS keys, count(*) FILTER ({f} > 1) AS varying, count(*) FILTER ({f} > 1) = 0 AS canonical FROM c" for f in ("home", "flag", "seen")))
def canonical_fields(spark, sf):
    """Fields of a node that are the same on all its days, and fields that vary."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return evidence.canonical_fields(rows.select(F.col("l_suppkey").alias("node"), F.col("s_nationkey").alias("home"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("seen")), "node", ["home", "flag", "seen"])


_VIEWS = "v AS (SELECT s_suppkey AS node, s_name AS name, NULL::INT AS home FROM supplier UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier UNION ALL SELECT s_suppkey, s_name || '?', NULL FROM supplier WHERE s_suppkey % 13 = 0)"


@query(f"WITH {_VIEWS} SELECT node, CASE WHEN count(DISTINCT name) <= 1 THEN min(name) END AS name, CASE WHEN count(DISTINCT home) <= 1 THEN min(home) END AS home, (CASE WHEN count(DISTINCT name) > 1 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT home) > 1 THEN 1 ELSE 0 END)::INT AS conflicts FROM v GROUP BY node")
def overlay_merge(spark, sf):
    """Views of a node that know different fields, united; a field on which they disagree is a conflict."""
    s = table(spark, sf, "supplier")
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    views = s.select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"), none.alias("home")).union(s.select("s_suppkey", text, "s_nationkey")).union(s.where("s_suppkey % 13 = 0").select("s_suppkey", F.concat("s_name", F.lit("?")), none))
    return evidence.overlay(views, "node", ["name", "home"])


@query("WITH new AS (SELECT c_nationkey AS part, c_custkey + 1000000 AS id FROM customer WHERE c_nationkey IN (3, 5) AND c_custkey % 2 = 0), s AS (SELECT c_nationkey AS part, c_custkey AS id FROM customer UNION ALL SELECT * FROM new), kept AS (SELECT c_nationkey AS part, c_custkey AS id FROM customer WHERE c_nationkey NOT IN (SELECT part FROM new) UNION ALL SELECT * FROM new) SELECT part, count(*) AS n, min(id) AS lo, max(id) AS hi FROM kept GROUP BY part")
def community_replace(spark, sf):
    """A community's rows replaced as a whole, the others untouched."""
    stored = table(spark, sf, "customer").select(F.col("c_nationkey").alias("part"), F.col("c_custkey").alias("id"))
    fresh = stored.where("part IN (3, 5) AND id % 2 = 0").withColumn("id", F.col("id") + 1000000)
    return evidence.replace_part(stored, fresh, "part").groupBy("part").agg(_n(), F.min("id").alias("lo"), F.max("id").alias("hi"))


@query(f"WITH {CE}, {_CASES}, a AS (SELECT identity, 1 AS attempt, row_ix % 3 = 0 AS failed FROM cases UNION ALL SELECT identity, 2, false FROM cases WHERE row_ix % 3 = 0) SELECT * FROM a")
def retry_schedule(spark, sf):
    """Each case once, and those that failed once more behind all others."""
    return evidence.retry_schedule(_cases(spark, sf), F.col("row_ix") % 3 == 0, ["identity"])


@query("SELECT c_mktsegment AS kind, count(*) AS n, count(DISTINCT c_nationkey) AS communities FROM customer GROUP BY 1")
def counts_by_kind(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("kind")).agg(_n(), F.count_distinct("c_nationkey").alias("communities"))


@query("SELECT s_nationkey AS cluster, count(*) AS n, string_agg(s_name, ',' ORDER BY s_name) AS node_ids FROM supplier WHERE contains(lower(s_name), '7') GROUP BY 1")
def cluster_nodes(spark, sf):
    """Nodes whose id holds a text, by cluster."""
    hits = table(spark, sf, "supplier").where(F.lower("s_name").contains("7"))
    return hits.groupBy(F.col("s_nationkey").alias("cluster")).agg(_n(), F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("node_ids"))


@query(f"""WITH {CE}, p AS (SELECT row_ix, event_id, day, score_a, score_b, {_PCT.format(s='score_a')} AS pa, {_PCT.format(s='score_b')} AS pb FROM ce WHERE split = 'test'), f AS (SELECT *, 0.7 * pb + 0.3 * pa AS fused FROM p)
 SELECT event_id, round(score_a, 9) AS baseline_raw, round(pa, 9) AS baseline_percentile, round(score_b, 9) AS gnn_raw, round(pb, 9) AS gnn_percentile, round(fused, 9) AS hybrid_score, row_number() OVER (PARTITION BY day ORDER BY score_a DESC, row_ix) AS baseline_rank, row_number() OVER (PARTITION BY day ORDER BY score_b DESC, row_ix) AS gnn_rank, row_number() OVER (PARTITION BY day ORDER BY round(fused, 12) DESC, row_ix) AS hybrid_rank FROM f""")
def decision_ledger(spark, sf):
    """Raw scores, percentiles, the fused score and the ranks of the day in all three orders; the day's ids are hashed by ordered_id_hash."""
    pool = crossing_events(spark, sf).where("split = 'test'").select("row_ix", "event_id", "day", *SCORES)
    both = average_percentile(average_percentile(pool, "score_a", "pa"), "score_b", "pb").withColumn("fused", 0.7 * F.col("pb") + 0.3 * F.col("pa"))
    by_day = W.partitionBy("day")
    ranks = [F.row_number().over(by_day.orderBy(o.desc(), "row_ix")) for o in (F.col("score_a"), F.col("score_b"), F.round("fused", 12))]
    return both.select("event_id", F.round("score_a", 9).alias("baseline_raw"), F.round("pa", 9).alias("baseline_percentile"), F.round("score_b", 9).alias("gnn_raw"), F.round("pb", 9).alias("gnn_percentile"), F.round("fused", 9).alias("hybrid_score"), ranks[0].alias("baseline_rank"), ranks[1].alias("gnn_rank"), ranks[2].alias("hybrid_rank"))


@query()
def representative_order(spark, sf):
    """The order in which the first 500 hybrid-only cases are tried: queues by (weekly strata, month), each giving its best case in turn.

    A sequence of choices over a bounded list: it is made on the driver.
    """
    cases = _cases(spark, sf).where("side = 'hybrid_only'").orderBy(F.col("uplift").desc(), "identity").limit(500).collect()
    order = simulate.round_robin([(r["identity"], float(r["uplift"]), float(r["same_day_rows"]), [f"weekday {r['day_text'][-1]}"], r["period"]) for r in cases])
    return spark.createDataFrame(list(enumerate(order)), "place int, identity string")


@query()
def structural_provenance(spark, sf):
    """Rows that explain the structural features of the smallest co-travelling person, at most 256."""
    from ..operators import edges
    from .graph import active_edges, _target

    found, _, _ = active_edges(spark, sf)
    rows = edges.provenance(found).select("source_row_id", "u", "v", "edge_type")
    return evidence.structural_rows(rows, _target(found))


