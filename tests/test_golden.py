"""Small worked cases: boundaries, ties, order."""

import datetime as dt
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import parse, rank
from chronoweave.operators import asof, components, edges, gnn, links, metrics, ml, simulate


def at(day, hour=0, minute=0, second=0, month=1):
    return dt.datetime(2024, month, day, hour, minute, second)


def pool(spark, rows):
    """rows: (row_ix, identity, t, hidden, score)."""
    df = spark.createDataFrame([(i, i, p, t, bool(h), float(s)) for i, p, t, h, s in rows], "row_ix long, event_id long, identity string, t timestamp, hidden boolean, s double")
    return df.withColumn("day", F.date_trunc("DAY", "t"))


def caught(spark, rows=()):
    return spark.createDataFrame(list(rows), "identity string, caught_time timestamp")


def test_daily_capacity_two_days(spark):
    rows = [(0, "a", at(1, 1), 1, 0.9), (1, "b", at(1, 2), 0, 0.8), (2, "c", at(1, 3), 1, 0.1), (3, "d", at(2, 1), 0, 0.7), (4, "e", at(2, 2), 1, 0.6), (5, "f", at(2, 3), 0, 0.5)]
    r = metrics.daily_capacity(pool(spark, rows), ("s",), (2,)).first()
    assert (r.budget, r.found, r.n_days) == (4, 2, 2)
    assert r.precision == 0.5 and round(r.recall, 4) == 0.6667 and round(r.f1, 4) == 0.5714


def test_official_catch_boundary(spark):
    rows = [(0, "before", at(2, 5), 1, 0.9), (1, "midnight", at(2, 6), 1, 0.8), (2, "sameday", at(2, 7), 1, 0.7), (3, "never", at(2, 8), 0, 0.6)]
    times = [("before", at(1, 23, 59, 59)), ("midnight", at(2)), ("sameday", at(2, 12))]
    _, found, stored = simulate.replay(pool(spark, rows), caught(spark, times), ("s",), (2,))
    assert stored.where("eligible").count() == 3
    assert {r.identity for r in found.collect()} == {"midnight", "sameday"}


@pytest.mark.parametrize("local_rows", [0, 1000])
def test_removal_starts_the_next_day(spark, local_rows):
    rows = [(0, "p", at(1, 1), 1, 0.9), (1, "p", at(1, 2), 1, 0.8), (2, "q", at(1, 3), 1, 0.7), (3, "p", at(2, 1), 1, 0.95), (4, "r", at(2, 2), 1, 0.5), (5, "x", at(2, 3), 0, 0.4), (6, "p", at(3, 1), 0, 0.9)]
    inspections, found, stored = simulate.replay(pool(spark, rows), caught(spark), ("s",), (2,), local_rows=local_rows)
    r = simulate.summary(inspections, found, stored).first()
    assert (r.people_found, r.budget, r.candidates_removed, r.hidden_removed) == (2, 4, 2, 1)
    assert {(x.identity, x.inspected_rank) for x in simulate.anchors(inspections).collect()} == {("p", 1), ("r", 1)}


@pytest.mark.parametrize("local_rows", [0, 1000])
def test_replay_against_plain_loop(spark, local_rows):
    rng = random.Random(3)
    rows = [(i, f"p{rng.randrange(12)}", at(1 + rng.randrange(4), rng.randrange(24)), rng.random() < 0.4, rng.randrange(6) / 6) for i in range(80)]
    official = {"p1": at(2, 3), "p2": at(1, 1)}
    _, found, _ = simulate.replay(pool(spark, rows), caught(spark, official.items()), ("s",), (3,), local_rows=local_rows)
    gone, want = set(), {}
    for day in range(1, 5):
        day_rows = [r for r in rows if r[2].day == day and r[1] not in gone and not (r[1] in official and official[r[1]] < at(day))]
        for r in sorted(day_rows, key=lambda r: (-r[4], r[0]))[:3]:
            if r[3]:
                want.setdefault(r[1], day)
        gone |= set(want)
    assert {r.identity: r.found_day.day for r in found.collect()} == want


def test_prior_seizure_counts_only_after_its_label(spark):
    df = spark.createDataFrame([(1, "p", at(1), at(5), True), (2, "p", at(3), None, False), (3, "p", at(6), None, False), (4, "p", at(5), None, False)], "row_ix long, identity string, t timestamp, label_available timestamp, seizure boolean")
    got = {r.row_ix: r.prior_seizure for r in asof.prior_mature(df, {"seizure": F.col("seizure")}).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}  # equality with the label's time does not count
    assert {r.row_ix: r.prior_crossings for r in asof.prior_counts(df).collect()} == {1: 0, 2: 1, 4: 2, 3: 3}


def test_training_labels_strictly_before_cutoff(spark):
    df = spark.createDataFrame([(1, at(1), at(9)), (2, at(1), at(10)), (3, at(1), at(11)), (4, at(1), None), (5, at(10), at(9))], "id long, t timestamp, label_available timestamp")
    assert [r.id for r in asof.eligible_supervision(df, "2024-01-10").collect()] == [1]


def test_hot_plate(spark):
    events = spark.createDataFrame([("a", "v", at(5)), ("b", "v", at(8)), ("a", "v", at(11))], "identity string, vehicle_id string, t timestamp")
    hot = spark.createDataFrame([("v", at(10))], "vehicle_id string, hot_time timestamp")
    got = {(r.avail_time.day, r.rel) for r in edges.shared_plate(events, hot).collect()}
    assert got == {(8, 2), (11, 3)}
    assert edges.active(edges.shared_plate(events, hot), F.lit(at(11))).where("rel = 3").count() == 0


def test_earliest_catch(spark):
    df = spark.createDataFrame([("p", at(5), True), ("p", at(3), True), ("q", None, True), ("r", at(1), False), (None, at(1), True)], "identity string, label_available timestamp, seizure boolean")
    assert [(r.identity, r.caught_time) for r in asof.earliest(df, F.col("seizure")).collect()] == [("p", at(3))]


def test_provenance_ids(spark):
    df = spark.createDataFrame([("a", "b", at(1), 0, "COTRAVEL")] * 2 + [("b", "a", at(1), 0, "COTRAVEL"), ("ab", "", at(1), 0, "COTRAVEL")], "u string, v string, avail_time timestamp, rel int, edge_type string")
    rows = edges.provenance(df).collect()
    assert len({r.source_row_id for r in rows}) == 4
    assert len({r.canonical_pair_group_id for r in rows if r.u in "ab" and r.v}) == 1
    assert len({r.canonical_pair_group_id for r in rows}) == 2

    def digest(*parts):
        return hashlib.sha256(b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)).hexdigest()

    stamp = at(1).strftime("%Y-%m-%dT%H:%M:%S+00:00")
    assert {r.source_row_id for r in rows if r.u == "a"} == {"edge:" + digest("a", "b", stamp, "COTRAVEL", str(i)) for i in (0, 1)}
    assert {r.canonical_pair_group_id for r in rows if r.u in "ab" and r.v} == {"pair:" + digest("a", "b", "COTRAVEL")}


def test_degrees_equal_the_self_join(spark):
    rng = random.Random(5)
    rows = [(f"p{rng.randrange(8)}", f"c{rng.randrange(5)}", f"v{rng.randrange(4)}" if rng.random() < 0.8 else None, at(1 + rng.randrange(9)), rng.random() < 0.2, at(1 + rng.randrange(12))) for _ in range(60)]
    events = spark.createDataFrame(rows, "identity string, co_key string, vehicle_id string, t timestamp, seizure boolean, label_available timestamp")
    homes = events.groupBy("identity").agg(F.min("t").alias("t")).withColumn("household", F.substring("identity", 2, 1).cast("int") % 3)
    moment = F.lit(at(7))
    found = edges.active(edges.multigraph(events, homes), moment)
    ends = found.select(F.col("u").alias("node"), "rel").union(found.select("v", "rel"))
    want = {(r.node, r.rel): r["count"] for r in ends.groupBy("node", "rel").count().collect()}
    got = {(r.identity, k): r[f"deg_{k}"] for r in edges.degrees(events, homes, moment).collect() for k in range(4) if r[f"deg_{k}"]}
    assert got == want


@pytest.mark.parametrize("local_edges", [0, 10_000])
def test_components_and_bridges(spark, local_edges):
    rng = random.Random(7)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(38)}
    df = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in pairs], "u string, v string")
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(40)], "node string")

    def roots(links):
        label = {i: i for i in range(40)}
        for _ in range(40):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    want = roots(pairs)
    got = {r.node: r.root for r in components.connected(df, nodes, local_edges=local_edges).collect()}
    assert got == {f"n{i:02}": f"n{want[i]:02}" for i in range(40)}
    if local_edges:
        parts = len(set(want.values()))
        cut = {p for p in pairs if len(set(roots(pairs - {p}).values())) > parts}
        assert {(r.u, r.v) for r in components.bridges(df).collect()} == {(f"n{a:02}", f"n{b:02}") for a, b in cut}


@pytest.mark.parametrize("local_rows", [0, 1000])
def test_capped_links_are_the_greedy_pass(spark, local_rows):
    rng = random.Random(11)
    rows = [(a, b, 1, rng.randrange(5)) for a, b in itertools.combinations(range(9), 2)]
    df = spark.createDataFrame(rows, "a int, b int, bits int, w int")
    assert sorted(map(tuple, links.capped(df, 3, local_rows).collect())) == sorted(links.greedy(rows, 3))


def test_ranks_and_thresholds(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 2, 2, 5, 5, 5, 0])], "row_ix long, s double")
    got = {r.row_ix: r.p * 8 for r in rank.average_percentile(df, "s", "p").collect()}
    assert got == {7: 1, 1: 2, 2: 3.5, 3: 3.5, 0: 5, 4: 7, 5: 7, 6: 7}
    values = sorted([3, 1, 2, 2, 5, 5, 5, 0])
    for q in (0.0, 0.3, 0.5, 0.95, 1.0):
        assert rank.quantile_higher(df, "s", q).first().threshold == np.quantile(values, q, method="higher")


def test_precision_divides_by_k_beyond_the_pool(spark):
    rows = [(0, "a", at(1), 1, 0.5), (1, "b", at(1), 0, float("nan"))]
    r = metrics.found_at(pool(spark, rows), ("s",), (10,)).first()
    assert (r.found, r.precision, r.recall) == (1, 0.1, 1.0)


def test_booleans_and_times(spark):
    df = spark.createDataFrame([("true",), ("FALSE",), ("1",), ("",), (None,), ("yes",)], "x string")
    got = df.select(*[f(F.col("x")).alias(n) for n, f in {"a": parse.bool_text, "b": parse.bool_filled, "c": parse.bool_strict_or_null, "d": parse.bool_token_or_null}.items()]).collect()
    assert [r.a for r in got] == [True, False, False, False, False, False]
    assert [r.b for r in got] == [True, True, True, False, False, True]
    assert [r.c for r in got] == [True, False, None, None, None, None]
    assert [r.d for r in got] == [True, False, True, None, None, None]
    with pytest.raises(Exception, match="not a boolean"):
        df.select(parse.bool_strict(F.col("x"))).collect()
    times = spark.createDataFrame([("2024-01-01T00:00:00",)], "x string")
    with pytest.raises(Exception, match="not an aware timestamp"):
        times.select(parse.time_strict(F.col("x"))).collect()


def test_bounded_bin_skips_what_is_no_number(spark):
    df = spark.createDataFrame([("0.0",), ("0.999",), ("7",), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(parse.bounded_bin(F.col("x"))).collect()] == [0, 11, 11, None, None]


def test_layers_against_numpy(spark):
    rng = np.random.default_rng(1)
    n, x = 7, None
    x = rng.normal(size=(n, 3))
    rows = [(int(a), int(b)) for a, b in rng.integers(0, n, (25, 2)) if a != b]
    feats = spark.createDataFrame([(f"n{i}", *map(float, x[i])) for i in range(n)], "node string, f0 double, f1 double, f2 double")
    pairs = gnn.pair_counts(spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in rows], "u string, v string"))
    adj = np.zeros((n, n))
    for a, b in rows:
        adj[b, a] += 1
    w, w2, bias = np.array(gnn.fixed_weights(3, 3, 1)), np.array(gnn.fixed_weights(3, 3, 2)), [0.1, 0.2, -0.3]

    def got(df):
        found = {r.node: [r.f0, r.f1, r.f2] for r in df.collect()}
        return np.array([found[f"n{i}"] for i in range(n)])

    mean = adj / np.maximum(adj.sum(axis=1, keepdims=True), 1)
    np.testing.assert_allclose(got(gnn.sage_layer(feats, pairs, w, w2, bias, True)), np.maximum(mean @ x @ w + x @ w2 + bias, 0), atol=1e-9)
    np.testing.assert_allclose(got(gnn.gin_layer(feats, pairs, w, bias, w2, bias, False)), np.maximum((x + adj @ x) @ w + bias, 0) @ w2 + bias, atol=1e-9)
    loops = adj + np.eye(n)
    d = loops.sum(axis=1)
    np.testing.assert_allclose(got(gnn.gcn_layer(feats, pairs, w, bias, False)), (loops / np.sqrt(np.outer(d, d))) @ x @ w + bias, atol=1e-9)
    z, s, t = x @ w, np.array([0.3, -0.2, 0.1]), np.array([0.1, 0.2, -0.3])
    e = (z @ s)[None, :] + (z @ t)[:, None]
    a = loops * np.exp(np.where(e > 0, e, 0.2 * e))
    np.testing.assert_allclose(got(gnn.gat_layer(feats, pairs, w, s, t, bias, False)), (a / a.sum(axis=1, keepdims=True)) @ z + bias, atol=1e-9)


def test_pooled_logit_is_the_mean_of_member_logits(spark):
    feats = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, -1.0), ("c", 5.0, 0.0)], "node string, f0 double, f1 double")
    roots = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "node string, root string")
    own = {r.node: r.logit for r in gnn.head(feats, [0.5, -1.0], 0.2).collect()}
    pooled = {r.node: r.logit for r in gnn.head(gnn.pool_by_root(feats, roots, 2), [0.5, -1.0], 0.2).collect()}
    assert pooled["a"] == pytest.approx((own["a"] + own["b"]) / 2) and pooled["c"] == pytest.approx(own["c"])


def test_outlier_scores_higher(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))] + [(300, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r.id: r.anomaly for r in ml.isolation_forest(df, df, ["a", "b"], trees=40, sample=128).collect()}
    assert got[300] == max(got.values())


def test_training_lowers_the_loss():
    rng = np.random.default_rng(2)
    x, near = rng.normal(size=(60, 4)), np.eye(60)
    _, losses = ml.train_sage(x, near, (x[:, 0] > 0).astype(float), np.arange(60), hidden=8, epochs=80)
    assert losses[-1] < 0.5 * losses[0]


def test_round_robin():
    cases = [("a", 3, 0, ["X"], "1"), ("b", 2, 0, ["X", "Y"], "1"), ("c", 1, 0, [], "1"), ("d", 5, 0, ["Y"], "2")]
    assert simulate.round_robin(cases) == ["c", "a", "b", "d"]
