"""Model arms.  Their numbers depend on the learner, so there is no SQL twin; tests hold them to their properties."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from ..functions.rank import quantile_higher
from ..operators import asof, edges, gnn, ml
from ..sources.adapter import crossing_events
from ..sources.shared import materialize
from .registry import query

FEATURES = ["prior_crossings", "prior_secondary", "prior_seizure", "prior_arrest", "k", "value"]


def feature_rows(spark, sf):
    ce = crossing_events(spark, sf)
    mature = asof.prior_mature(ce, {f: F.col(f) for f in ("secondary", "seizure", "arrest")}).drop("identity")
    return asof.prior_counts(ce).join(mature, "row_ix").select("event_id", "row_ix", "split", "region", "hidden", "seizure", "label_available", "t", *[F.col(c).cast("double").alias(c) for c in FEATURES])


@query()
def gbt_scores(spark, sf):
    rows = feature_rows(spark, sf)
    train = asof.eligible_supervision(rows.where("split = 'train'"), "2024-01-15")
    return ml.fit_predict(train, rows.where("split <> 'train'"), FEATURES, "seizure").select("event_id", "split", "p")


@query()
def logistic_scores(spark, sf):
    rows = feature_rows(spark, sf)
    train = asof.eligible_supervision(rows.where("split = 'train'"), "2024-01-15")
    return ml.fit_predict(train, rows.where("split <> 'train'"), FEATURES, "seizure", model="logistic").select("event_id", "split", "p")


@query()
def isolation_forest_scores(spark, sf):
    rows = feature_rows(spark, sf)
    return ml.isolation_forest(rows.where("split = 'train'"), rows.where("split <> 'train'"), FEATURES).select("event_id", "split", "anomaly")


#: The four arms: two learn the distribution of the features alone, two the catches that were visible at the cutoff.
ARMS = ("tabular_unlabeled", "relational_unlabeled", "relational_caught_supervised", "tabular_caught_supervised")
#: A region is skipped if one of its splits has fewer rows.
LEAST_ROWS = 50


def arm_status(rows, cutoff: str):
    """region, train, validation, test (rows), classes (of the labels visible at the cutoff among training rows)."""
    def rows_of(split):
        return F.count_if(F.col("split") == split).alias(split)

    label = F.col("seizure") & F.coalesce(F.col("label_available") < F.lit(cutoff).cast("timestamp"), F.lit(False))
    return rows.groupBy("region").agg(*map(rows_of, ("train", "validation", "test")), F.count_distinct(F.when(F.col("split") == "train", label)).alias("classes"))


#: Arms that run at a time: most of an arm's jobs are small and leave cores idle.
ARMS_AT_A_TIME = 4


@query()
def regional_arms(spark, sf, cutoff="2024-01-15"):
    """Region by region and arm by arm: fit, freeze scores and a label-free threshold, and only then look at what was hidden.

    A region with fewer than 50 rows in a split is skipped, and a supervised arm where the labels are of one class.
    """
    from .arms import CODED, HISTORY, PROXIES, relational

    mature = F.coalesce(F.col("label_available") < F.lit(cutoff).cast("timestamp"), F.lit(False))
    columns = [*HISTORY, "hour", *CODED, *PROXIES]
    values = [F.col(f"{c}_code" if c in CODED else c).cast("double").alias(c) for c in columns]
    found = relational(spark, sf).select("event_id", "hidden", "seizure", "label_available", (F.col("seizure") & mature).alias("label"), *values, "area", "split")
    rows = materialize(found, "arm-rows", ("area", "split"))
    status = arm_status(rows.select(F.col("area").alias("region"), "split", "seizure", "label_available"), cutoff).collect()

    def run(region: str, arm: str):
        own = rows.where(F.col("area") == region)
        train, rest = own.where("split = 'train'"), own.where("split <> 'train'")
        names = columns if arm.startswith("relational") else columns[: -len(PROXIES)]
        if arm.endswith("supervised"):
            scored = ml.fit_predict(train, rest, names, "label", rounds=10).withColumnRenamed("p", "s")
        else:
            scored = ml.isolation_forest(train, rest, names, trees=50).withColumnRenamed("anomaly", "s")
        frozen = materialize(scored.select("event_id", "split", "hidden", "s"), "frozen")
        limit = quantile_higher(frozen.where("split = 'validation'"), "s", 0.95)
        hit = F.col("s") >= F.col("threshold")
        part = frozen.where("split = 'test'").crossJoin(F.broadcast(limit)).agg(F.lit(arm).alias("arm"), F.lit(region).alias("region"), F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("selected"), F.count_if(hit & F.col("hidden")).alias("found"), F.avg(hit.cast("double")).alias("alert_rate"))
        return tuple(part.first())

    wanted = []
    for state in sorted(status, key=lambda r: r["region"]):
        if min(state["train"], state["validation"], state["test"]) >= LEAST_ROWS:
            wanted += [(state["region"], arm) for arm in ARMS if state["classes"] >= 2 or not arm.endswith("supervised")]
    with ThreadPoolExecutor(ARMS_AT_A_TIME) as pool:
        done = [pool.submit(inheritable_thread_target(spark)(run), *pair) for pair in wanted]
        out = [x.result() for x in done]
    return spark.createDataFrame(out, "arm string, region string, n long, selected long, found long, alert_rate double")


@query()
def sage_trained(spark, sf, day=None, sample=5000):
    """A small network fitted on a bounded sample of one day's snapshot (at most 5,000 nodes by id, and their edges), then scored for every node over all edges."""
    from .graph import DAY, node_features

    rows, members, _ = node_features(spark, sf, day or DAY)
    members = materialize(members, "members")
    features = materialize(rows.select("node", *[F.log1p(f"f{i}").alias(f"f{i}") for i in range(7)], F.col("f7").alias("label")), "features")
    drawn = materialize(features.orderBy("node").limit(sample), "drawn")
    kept = drawn.collect()
    place = {r["node"]: i for i, r in enumerate(kept)}
    x = np.array([[r[f"f{i}"] for i in range(7)] for r in kept])
    y = np.array([r["label"] for r in kept])
    near = np.zeros((len(kept), len(kept)), np.float32)
    for r in edges.pairs_between(members, drawn, drawn).groupBy("u", "v").agg(F.sum("w").alias("w")).toLocalIterator(prefetchPartitions=True):
        near[place[r["v"]], place[r["u"]]] = r["w"]
    near /= np.maximum(near.sum(axis=1, keepdims=True), 1)
    w, losses = ml.train_sage(x, near, y, np.arange(len(kept)))
    hidden = gnn.sage_layer(features.drop("label"), members, w["l1"].tolist(), w["r1"].tolist(), w["b1"].tolist(), relu=True)
    z = gnn.sage_layer(hidden, members, w["l2"].tolist(), w["r2"].tolist(), w["b2"].tolist(), relu=False)
    return z.select("node", (1 / (1 + F.exp(-F.col("f0")))).alias("p"), F.lit(losses[0]).alias("first_loss"), F.lit(losses[-1]).alias("last_loss"))


@query()
def sage_trained_latest(spark, sf):
    """The same on the snapshot after the last event."""
    from .graph import last_moment

    return sage_trained(spark, sf, last_moment(spark, sf))
