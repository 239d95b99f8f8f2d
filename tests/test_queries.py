"""Every registered query against its SQL twin on the smallest tables; those without one for schema and rows."""

import pytest
from compare import duck_rows, spark_rows

from chronoweave.plans import graph, registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(name, spark, sf, duck):
    columns, rows = spark_rows(registry.QUERIES[name](spark, sf))
    other_columns, other = duck_rows(duck, registry.ORACLES[name])
    assert columns == other_columns
    assert rows == other


@pytest.mark.parametrize("name, column", [("gbt_scores", "p"), ("logistic_scores", "p"), ("isolation_forest_scores", "anomaly")])
def test_model_scores_every_later_row(name, column, spark, sf, duck):
    rows = registry.QUERIES[name](spark, sf).collect()
    wanted = {r[0] for r in duck.execute("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'").fetchall()}
    assert {r.event_id for r in rows} == wanted and len(rows) == len(wanted)
    assert all(0 <= r[column] <= 1 for r in rows) and len({r[column] for r in rows}) > 10


def test_regional_arms_freeze_before_they_look(spark, sf):
    plan = {(r.arm, r.region): (r.test, r.status) for r in registry.QUERIES["arm_plan"](spark, sf).collect()}
    rows = registry.QUERIES["regional_arms"](spark, sf).collect()
    assert {r.arm for r in rows} <= {arm for arm, _ in plan} and rows
    for r in rows:
        assert 0 <= r.found <= r.selected <= r.n and abs(r.alert_rate - r.selected / r.n) < 1e-12
        if (r.arm, r.region) in plan and plan[r.arm, r.region][1] == "completed":
            assert r.n == plan[r.arm, r.region][0]


def test_counterfactuals_start_from_the_whole_graph(spark, sf):
    rows = {r.removed: r for r in registry.QUERIES["counterfactual_rank"](spark, sf).collect()}
    pooled = {r.node: r.probability for r in registry.QUERIES["component_mean_pool"](spark, sf).collect()}
    whole = rows["none"]
    assert set(rows) == {"none", "COTRAVEL", "RESIDENCE", "SHARED_PLATE", "SHARED_PLATE_HOT"}
    assert any(abs(whole.probability - p) < 1e-5 for p in pooled.values()) and 1 <= whole["rank"] <= len(pooled)
    assert abs(sum(p > whole.probability + 1e-6 for p in pooled.values()) + 1 - whole["rank"]) <= sum(abs(p - whole.probability) <= 1e-6 for p in pooled.values())


def test_orders_that_are_made_on_the_driver(spark, sf):
    cases = [r for r in registry.QUERIES["exclusive_cases"](spark, sf).collect() if r.side == "hybrid_only"]
    order = registry.QUERIES["representative_order"](spark, sf).orderBy("place").collect()
    assert sorted(r.identity for r in order) == sorted(r.identity for r in cases)
    rows = registry.QUERIES["structural_provenance"](spark, sf).collect()
    assert 0 < len(rows) <= 256 and {r.edge_type for r in rows} <= {"COTRAVEL", "RESIDENCE"} and len({r.source_row_id for r in rows}) == len(rows)


@pytest.mark.parametrize("name", ["components_asof", "component_struct", "canonical_edges", "relationship_categories", "sage_forward", "factor_specs"])
def test_latest_is_the_twin_after_the_last_event(name, spark, sf, duck):
    day = graph.last_moment(spark, sf)
    assert duck.execute(f"SELECT count(*) FROM events WHERE ts >= TIMESTAMP '{day}'").fetchone()[0] == 0
    columns, rows = spark_rows(registry.QUERIES[name + "_latest"](spark, sf))
    other_columns, other = duck_rows(duck, registry.ORACLES[name].replace(graph.DAY, day))
    assert columns == other_columns
    assert rows == other


def test_every_day_and_the_whole_projection(spark, sf, duck):
    days = [r.day_text for r in registry.QUERIES["components_by_day_latest"](spark, sf).collect()]
    assert sorted(days)[-1] == graph.last_moment(spark, sf)
    assert len(days) == len(set(days)) == duck.execute("SELECT date_diff('day', min(ts), max(ts)) + 1 FROM events").fetchone()[0]
    rows = registry.QUERIES["local_projection_latest"](spark, sf).collect()
    assert len({x for r in rows for x in (r.u, r.v)}) > 24 and len(rows) <= 1024


def test_trained_network_scores_every_node(spark, sf):
    """Fitted on 50 nodes, scored for all; with all nodes in the sample the scores are those of the network's own forward pass."""
    import numpy as np

    from chronoweave.operators import gnn, ml
    from chronoweave.plans import learning

    rows, _, _ = graph.node_features(spark, sf)
    found = graph.active_edges(spark, sf)[0]
    nodes = sorted(rows.collect(), key=lambda r: r["node"])
    some = {r["node"]: r["p"] for r in learning.sage_trained(spark, sf, sample=50).collect()}
    assert set(some) == {r["node"] for r in nodes} and len(nodes) > 50
    at = {r["node"]: i for i, r in enumerate(nodes)}
    x = np.log1p(np.array([[r[f"f{i}"] for i in range(7)] for r in nodes]))
    near = np.zeros((len(nodes), len(nodes)))
    for r in gnn.pair_counts(found).collect():
        near[at[r["v"]], at[r["u"]]] = r["w"]
    first = near[:50, :50] / np.maximum(near[:50, :50].sum(axis=1, keepdims=True), 1)
    w, _ = ml.train_sage(x[:50], first.astype(np.float32), np.array([r["f7"] for r in nodes[:50]]), np.arange(50))
    z = ml.sage_step(x, near / np.maximum(near.sum(axis=1, keepdims=True), 1), w)[1][:, 0]
    assert all(abs(some[n] - 1 / (1 + np.exp(-z[i]))) < 1e-5 for n, i in at.items())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())
