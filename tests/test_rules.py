"""Contracts that raise, parsing rules, evidence rules and bridges, on small cases and against plain loops."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import parse
from chronoweave.functions.rank import text_positions
from chronoweave.operators import asof, components, contracts, edges, evidence, metrics, ties


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_parsing_that_raises(spark):
    assert one(spark, parse.bool_token, " TRUE ") is True and one(spark, parse.bool_token, "0") is False
    for bad in ("yes", "", None):
        with pytest.raises(Exception, match="not a boolean token"):
            one(spark, parse.bool_token, bad)
    assert parse.as_utc("2024-01-01 00:00") == dt.datetime(2024, 1, 1, tzinfo=dt.UTC) == parse.as_utc("2024-01-01T02:00:00+02:00")
    with pytest.raises(ValueError):
        parse.aware_cutoff("2024-01-01T00:00:00")
    contract = "train<2024-01-15; validation<2024-01-22; test>=2024-01-22"
    rows = spark.createDataFrame([(contract,), (contract,), (None,)], "temporal_cutoff string")
    assert [t.day for t in parse.split_contract(rows)] == [15, 22]
    for texts in (["train<x"], [contract, contract + " "], [contract.replace("test>=2024-01-22", "test>=2024-01-23")], []):
        with pytest.raises(ValueError):
            parse.split_contract(spark.createDataFrame([(t,) for t in texts], "temporal_cutoff string"))
    payload = {"a": [{"label": 1}, {"b": {"label": {"label": 2}}}], "c": (3,)}
    assert parse.forbidden_paths(payload, {"label"}) == ["$.a[0].label", "$.a[1].b.label", "$.a[1].b.label.label"]
    assert parse.json_safe({1: {"b", "a"}, "t": dt.date(2024, 1, 2), "x": (1.5, None)}) == {"1": ["a", "b"], "t": "2024-01-02", "x": [1.5, None]}
    with pytest.raises(ValueError):
        parse.json_safe([float("nan")])
    assert [one(spark, parse.is_finite, v, "double") for v in (1.0, float("nan"), float("-inf"), None)] == [True, False, False, False]
    assert one(spark, lambda x: parse.clamped(x), 1.5, "double") == 1.0
    assert one(spark, lambda x: parse.slug(x), "a b/c!!d") == "a-b-c-d"


def test_joins_that_raise(spark):
    def table(rows, schema="event_id long, identity string"):
        return spark.createDataFrame(rows, schema)

    good, other = table([(1, "p"), (2, "q")]), table([(2, "q"), (1, "p")])
    frozen = good.withColumn("row_ix", 3 - F.col("event_id"))
    assert [r.event_id for r in contracts.frozen_with_oracle(frozen, other).collect()] == [2, 1]
    with pytest.raises(ValueError, match="other persons for events: .1."):
        contracts.frozen_with_oracle(frozen, table([(2, "q"), (1, "x")]))
    for left, right, what in ((good, table([(1, "p")]), "lacks"), (table([(1, "p")]), good, "unexpected"), (table([(1, "p"), (1, "p")]), good, "repeated")):
        with pytest.raises(ValueError, match=what):
            contracts.one_to_one(left, right, "event_id")
    with pytest.raises(ValueError, match="not finite: ..b"):
        contracts.require_finite(spark.createDataFrame([(1.0, float("nan"))], "a double, b double"), "a", "b")
    audit = {r.rule: r.n for r in contracts.exactly_once(table([(1, "a"), (2, "b"), (3, "c")]), spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "identity string")).collect()}
    assert audit == {"uncovered": 1, "covered_twice": 1, "unknown": 1}
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "c string, d string")
    with pytest.raises(Exception, match="missing categorical value in d"):
        asof.encode_many(rows, rows, {"c": "cc", "d": "dd"}, nulls_raise=True).collect()
    assert sorted(tuple(r) for r in asof.encode_many(rows, rows.where("c = 'b'"), {"c": "cc", "d": "dd"}).select("cc", "dd").collect()) == [(-1, -1), (0, -1)]
    train = spark.createDataFrame([(True,), (False,), (None,)], "true_contraband_present boolean")
    assert [asof.training_rows(train, m)[0].count() for m in ("strict", "assisted")] == [3, 2]
    with pytest.raises(ValueError, match="unknown anomaly mode"):
        asof.training_rows(train, "loose")
    nothing = edges.provenance(spark.createDataFrame([("a", None, dt.datetime(2024, 1, 1), 0, "T")], "u string, v string, avail_time timestamp, rel int, edge_type string"))
    with pytest.raises(Exception, match="null v"):
        nothing.collect()


def test_many_categories_are_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(asof, "FEW_CATEGORIES", 10)
    rows = spark.createDataFrame([(f"c{i * 7 % 50:02}",) for i in range(200)], "c string")
    got = {r.c: r.code for r in asof.encode(rows, rows, "c", "code").collect()}
    assert got == {f"c{i:02}": i for i in range(50)}
    places = {r.c: r.place for r in text_positions(rows.distinct().withColumn("t", F.lit(1)), "c", "t", "place").collect()}
    assert places == got


def test_best_threshold_is_the_first_of_the_best(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20) / 20, rng.random() < 0.3) for _ in range(80)]
    got = metrics.best_threshold(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first()
    low, high = min(s for s, _ in rows), max(s for s, _ in rows)
    best = (-1.0, 0.0)
    for step in range(100):
        at = low + (high - low) * step / 99
        tp, sel, pos = sum(y for s, y in rows if s >= at), sum(s >= at for s, _ in rows), sum(y for _, y in rows)
        f1 = 2 * tp / (sel + pos) if tp else 0.0
        if f1 > best[0] + 1e-12:
            best = f1, at
    assert abs(got["threshold"] - best[1]) < 1e-9 and abs(got["f1"] - best[0]) < 1e-9
    assert metrics.best_threshold(spark.createDataFrame([(0.5, False)], "s double, y boolean"), "s", "y").count() == 0


def reachable(pairs, start, without=None):
    seen, front = {start}, [start]
    while front:
        x = front.pop()
        for p in pairs:
            if p != without and x in p:
                y = p[0] if p[1] == x else p[1]
                if y not in seen:
                    seen.add(y)
                    front.append(y)
    return seen


@pytest.mark.parametrize("local_edges", [1000, 0])
def test_bridges_at_any_depth(spark, local_edges):
    rng = random.Random(4)
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(14)]
    more = [tuple(sorted(rng.sample([f"n{i:02}" for i in range(15)], 2))) for _ in range(2)] + [("x1", "x2"), ("x2", "x3"), ("x1", "x3"), ("x3", "x4")]
    pairs = sorted({*chain, *more})
    want = {p for p in pairs if p[1] not in reachable(pairs, p[0], without=p)}
    df = spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs[:4]], ("n00", "n00")], "u string, v string")
    assert {tuple(r) for r in components.bridges(df, local_edges).collect()} == want


def test_stars_connect_what_pairs_connect(spark):
    rng = random.Random(5)
    rows = [(f"g{rng.randrange(12)}", f"p{rng.randrange(15)}", dt.datetime(2024, 1, 1 + rng.randrange(6))) for _ in range(40)]
    events = spark.createDataFrame(rows, "co_key string, identity string, t timestamp")
    for day in (2, 4, 9):
        moment = F.lit(dt.datetime(2024, 1, day))
        kinds = (edges.stars(events, "co_key"), edges.cotravel(events))
        a, b = ({tuple(r) for r in components.connected(edges.active(e, moment)).select("node", "root").collect()} for e in kinds)
        assert a == b


def test_ties(spark):
    groups = [(1, g, m) for g, size in enumerate((1, 2, 3, 12, 13)) for m in range(size)] + [(2, 0, m) for m in (1, 0)]
    got = {(r.a, r.b): (r.bits, r.w) for r in ties.cliques(spark.createDataFrame(groups, "bit int, grp int, member int")).collect()}
    want: dict = {}
    for bit, members in ((1, range(2)), (1, range(3)), (1, range(12)), (2, range(2))):
        for p in itertools.combinations(members, 2):
            bits, w = want.get(p, (0, 0))
            want[p] = bits | bit, w + 1
    assert got == want
    party = spark.createDataFrame([("x", f"m{i:02}", i) for i in range(20)], "party string, who string, place int")
    assert ties.party_pairs(party, "party", "who", "place", 12).count() == 66


def test_evidence_rules(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(7)], "id int, w double")
    got = [(r.id, r.page, r.pages) for r in evidence.page(rows, [F.col("w").desc()], 9, 3).collect()]
    assert got == [(0, 2, 3)] and [r.id for r in evidence.page(rows, [F.col("id")], -4, 0).collect()] == [0]
    assert evidence.page(rows.limit(0), [F.col("id")], 3, 5).count() == 0
    cases = [("a", "i1", 0.1, 2), ("a", "i2", 0.9, 1), ("b", "i1", 0.1, 1), ("b", "i2", 0.9, 1), ("c", "i2", 0.5, None), ("c", "i1", 0.5, 1), ("c", "i3", 0.7, 2), ("c", "i4", 0.1, 3)]
    top = evidence.attribution(spark.createDataFrame(cases, "case string, id string, weight double, producer_rank int"), keys=("case",)).orderBy("case", "rk").collect()
    assert [(r["case"], r.id) for r in top] == [("a", "i2"), ("a", "i1"), ("b", "i2"), ("b", "i1"), ("c", "i3"), ("c", "i1"), ("c", "i2")]
    e = spark.createDataFrame([(f"e{i}", i % 2, "1", i) for i in range(9)], "edge_id string, rel int, degree_bin string, w int")
    pairs = evidence.matched_controls(e, F.col("w") < 6).collect()
    used = [r.control_edge for r in pairs if r.control_edge]
    assert len(pairs) == 6 and sorted(used) == ["e6", "e7", "e8"] and all((int(r.selected_edge[1]) - int(r.control_edge[1])) % 2 == 0 for r in pairs if r.control_edge)
    statuses = [evidence.stability(F.lit(float(x)), F.lit(f), F.lit(q)) for x, f, q in ((-1, 1.0, 0.0), (1, 2 / 3, 0.25), (1, 0.5, 0.1), (0, 1.0, 0.0), (1, 1.0, 0.3))]
    assert list(spark.range(1).select(*statuses).first()) == ["countervailing", "stable", "unstable", "unstable", "unstable"]
    rows = [("r3", "b", "c", "COTRAVEL"), ("r1", "a", "b", "COTRAVEL"), ("r2", "c", "d", "RESIDENCE"), ("r9", "x", "y", "RESIDENCE"), ("r4", "d", "e", "COTRAVEL"), ("r5", "e", "f", "SHARED_PLATE")]
    found = evidence.structural_rows(spark.createDataFrame(rows, "source_row_id string, u string, v string, edge_type string"), spark.createDataFrame([("a",)], "node string"))
    assert [r.source_row_id for r in found.collect()] == ["r1", "r2", "r3", "r4"]
    two = evidence.structural_rows(spark.createDataFrame(rows, "source_row_id string, u string, v string, edge_type string"), spark.createDataFrame([("a",)], "node string"), 2)
    assert [r.source_row_id for r in two.collect()] == ["r1", "r3"]
