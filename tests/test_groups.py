"""Memberships against the pairs that they stand for."""

import datetime as dt
import random
import re

import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from chronoweave.operators import components, edges, gnn, links
from chronoweave.plans import graph, registry

MOMENT = dt.datetime(2024, 1, 9)


@pytest.fixture(scope="module")
def graph_rows(spark):
    """(events, homes, pairs, memberships, timed rows): hot and cold plates, repeated and equal observations, a row without identity."""
    rng = random.Random(3)
    at = lambda: dt.datetime(2024, 1, 1 + rng.randrange(12))
    rows = [(f"p{rng.randrange(14):02}", f"c{rng.randrange(14)}", f"v{rng.randrange(9)}" if rng.random() < 0.7 else None, at(), rng.random() < 0.2, at()) for _ in range(70)]
    rows += rows[:3] + [(None, "c1", "v1", dt.datetime(2024, 1, 2), False, dt.datetime(2024, 1, 2))]
    events = spark.createDataFrame(rows, "identity string, co_key string, vehicle_id string, t timestamp, seizure boolean, label_available timestamp").cache()
    homes = events.where("identity IS NOT NULL").groupBy("identity").agg(F.min("t").alias("t")).withColumn("household", F.substring("identity", 3, 1))
    found = edges.active(edges.multigraph(events, homes), F.lit(MOMENT)).cache()
    return events, homes, found, edges.memberships(events, homes, F.lit(MOMENT)).cache(), edges.timed_rows(events, homes, F.lit(MOMENT)).cache()


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_targets_pairs_and_row_counts(spark, graph_rows):
    _, _, found, members, _ = graph_rows
    assert plain(edges.target(members)) == plain(found.where("rel = 0").agg(F.min("u")))
    want = gnn.pair_counts(found, "rel")
    assert plain(edges.pairs_between(members)) == plain(want)
    some = spark.createDataFrame([(f"p{i:02}",) for i in range(0, 14, 2)], "node string")
    kept = {f"p{i:02}" for i in range(0, 14, 2)}
    assert plain(edges.pairs_between(members, some, some, both_ways=False)) == sorted(r for r in plain(want) if {r[0], r[1]} <= kept and r[0] < r[1])
    assert plain(edges.rows_of(members, some)) == [(r[0], r[1]) for r in plain(found.groupBy("u").count()) if r[0] in kept]


def test_hops_over_groups(spark, graph_rows):
    _, _, found, members, _ = graph_rows
    for hops in (1, 2):
        assert plain(components.group_distances(members, edges.target(members), hops)) == plain(components.distances(found, edges.target(members), hops))


def test_ties_are_the_memberships_out_of_one_pass(spark, sf, duck, graph_rows):
    events, _, _, members, _ = graph_rows
    got = edges.group_ties(events.where(F.col("t") < F.lit(MOMENT)), {0: F.col("co_key"), 1: F.substring("identity", 3, 1), 9: F.col("vehicle_id")})
    assert plain(got) == plain(members.where("kind <> 2").select("kind", "grp", "node"))
    day = graph.last_moment(spark, sf)
    plan = graph.group_ties(spark, sf, day)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    assert spark_rows(registry.QUERIES["khop2_latest"](spark, sf)) == duck_rows(duck, registry.ORACLES["khop2"].replace(graph.DAY, day))


def test_removed_pairs_leave_the_sums(spark, graph_rows):
    events, _, found, members, _ = graph_rows
    x = spark.createDataFrame([(f"p{i:02}", float(i % 5), i / 7) for i in range(14)], "node string, f0 double, f1 double")
    touches = (F.col("u") == "p00") | (F.col("v") == "p00")
    for rel in range(4):
        cut = edges.pairs_between(members).where(touches & (F.col("rel") == rel))
        left = gnn.pair_counts(found.where(~(touches & (F.col("rel") == rel))))
        got = {r[0]: r[1:] for r in plain(gnn.group_aggregate(x, members, 2, "mean", removed=cut))}
        want = {r[0]: r[1:] for r in plain(gnn.aggregate(x, left, 2, "mean"))}
        assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for n in got for a, b in zip(got[n], want[n], strict=True))


def test_attention_without_pairs(spark, graph_rows):
    _, _, found, members, _ = graph_rows
    for scale in (1.0, 300.0):  # large scores must not overflow
        x = spark.createDataFrame([(f"p{i:02}", scale * (i % 5 - 2), scale * (i % 3 - 1) / 2) for i in range(15)], "node string, f0 double, f1 double")
        head = ([[0.4, -0.3], [0.2, 0.5]], [0.3, -0.2], [0.1, 0.2], [0.1, -0.1])
        got = {r[0]: r[1:] for r in plain(gnn.gat_heads(x, members, [head, head], relu=False))}
        want = {r[0]: r[1:] for r in plain(gnn.gat_heads(x, gnn.pair_counts(found), [head, head], relu=False))}
        assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 * scale for n in got for a, b in zip(got[n], want[n], strict=True))


@pytest.mark.parametrize("held_rows", [0, 10_000])
def test_rows_that_meet_in_their_groups(spark, graph_rows, held_rows):
    _, _, found, members, rows = graph_rows
    assert plain(edges.provenance(edges.timed_pairs(rows, held_rows))) == plain(edges.provenance(found))
    near = components.group_distances(members, edges.target(members), 2)
    a, b = (near.select(F.col("node").alias(n), F.col("distance").alias(d)) for n, d in (("u", "x"), ("v", "y")))
    want = found.join(a, "u").join(b, "v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "rel").agg(F.count(F.lit(1)).alias("n"), F.min("avail_time").alias("first"), F.max(F.greatest("x", "y")).alias("hop"))
    assert plain(edges.canonical(rows, near, held_rows)) == plain(want)


@pytest.mark.parametrize("held_rows", [0, 10_000])
def test_pairs_are_not_shuffled(spark, graph_rows, monkeypatch, held_rows):
    """Above the rows that are held, members meet in many cells; no exchange has a pair of nodes, and each pair is made in one direction."""
    _, _, found, members, rows = graph_rows
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # a cached plan would be shown with its own exchanges
    near = components.group_distances(members, edges.target(members), 2)
    want = [plain(edges.provenance(found)), plain(edges.canonical(rows, near))]
    monkeypatch.setattr(edges, "CELL_PAIRS", 20, raising=False)
    made = edges.timed_pairs(rows, held_rows)
    counted = {frozenset(r[:2]) for r in plain(made.select("u", "v").distinct())}
    assert made.select("u", "v").distinct().count() == len(counted) == found.where("u < v").select("u", "v").distinct().count()
    got = [edges.provenance(made), edges.canonical(rows, near, held_rows)]
    assert [plain(x) for x in got] == want
    for x in got:
        plan = x._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert exchanges and all(re.search(r"Exchange hashpartitioning\((cell|u|a)#\d+, \d+\)", line) for line in exchanges)


@pytest.mark.parametrize("local_edges", [0, 1000])
def test_bridges_of_groups(spark, local_edges):
    groups = {"a": "12", "b": "21", "c": "234", "d": "45", "e": "56", "f": "6789", "g": "58", "h": "ab", "i": "x", "j": "3y"}
    rows = spark.createDataFrame([(g, n, dt.datetime(2024, 1, 1)) for g, ns in groups.items() for n in ns], "co_key string, identity string, t timestamp")
    found = edges.cotravel(rows)
    got = plain(components.group_bridges(edges.travel_groups(rows, F.lit(MOMENT)), local_edges))
    assert got == plain(components.bridges(found)) == [("1", "2"), ("3", "y"), ("4", "5"), ("a", "b")]
    assert plain(components.group_bridges(edges.travel_groups(rows.where("co_key IN ('c', 'f')"), F.lit(MOMENT)), local_edges)) == []


@pytest.mark.parametrize("local_rows", [5, 40, 10_000])
def test_capped_links_of_a_long_chain_of_ties(spark, local_rows):
    """Equal weights: each link waits for the one before it at its end, and the rounds of the pass still stay few."""
    rows = [(i, j, 1, 1) for i in range(25) for j in range(i + 1, min(25, i + 5))]
    df = spark.createDataFrame(rows, "a int, b int, bits int, w int")
    assert plain(links.capped(df, 3, local_rows)) == sorted(links.greedy(rows, 3), key=repr)


def test_year_counts_have_no_frame_with_two_moving_ends(spark, sf):
    """Such a frame is counted anew for each row: a key with many rows costs their square."""
    plan = registry.QUERIES["relational_matrix"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and not re.search(r"rangeframe, -\d+l?, -1", plan)


def test_features_of_events_years_apart_join_no_rows(spark, tmp_path):
    """Ties, null values and labels, facts that mature at another event's moment, and times more than a year apart; rows are not joined by their ids."""
    import duckdb

    rng = random.Random(5)
    stamps = [dt.datetime(2022, 1, 1) + dt.timedelta(days=365 * rng.randrange(3), hours=rng.randrange(60)) for _ in range(40)]
    rows = [(i, rng.choice(stamps), rng.choice([1, 2, 51, 101]), rng.choice(["error", "purchase", "view"]), rng.choice([None, 30.0, 70.0, 120.0]), rng.choice([None, '{"k": 2}', '{"k": 12}', '{"k": 24}'])) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = registry.QUERIES["relational_matrix"](spark, str(tmp_path))
    columns, got = spark_rows(found)
    other_columns, want = duck_rows(con, registry.ORACLES["relational_matrix"])
    assert columns == other_columns
    assert got == want and len(got) == 300
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any(re.search(r"row_ix|event_id", line) for line in joins)
