"""Capacity metrics: what is found within a budget, overall, per day, per stratum, and at thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rank import stable_order, top, value_positions


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def arms(pool: DataFrame, scores: tuple[str, ...], *keep: str) -> DataFrame:
    """Long form: keep columns, arm, s."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("arm"), F.col(c).alias("s")) for c in scores])).alias("x")
    return pool.select(*keep, stacked).select(*keep, "x.arm", "x.s")


def found_at(pool: DataFrame, scores: tuple[str, ...], ks: tuple[int, ...]) -> DataFrame:
    """arm, k, found, precision (found / k even beyond the pool), recall, f1, over one global order."""
    total = pool.agg(F.sum(F.col("hidden").cast("long")).alias("positives"))
    heads = None
    for c in scores:
        head = top(pool.select("row_ix", "hidden", F.col(c).alias("s")), max(ks), stable_order("s")).withColumn("arm", F.lit(c))
        heads = head if heads is None else heads.union(head)
    budgets = heads.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).groupBy("arm", "k").agg(F.sum((F.col("hidden") & (F.col("rk") <= F.col("k"))).cast("long")).alias("found"))
    out = budgets.crossJoin(F.broadcast(total))
    p, r = F.col("found") / F.col("k"), share(F.col("found"), F.col("positives"))
    return out.select("arm", "k", "found", p.alias("precision"), r.alias("recall")).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def daily_ranks(pool: DataFrame, scores: tuple[str, ...], *keep: str) -> DataFrame:
    """Each day's rows ranked by score, by arm."""
    long = arms(pool, scores, "row_ix", "day", "hidden", *keep)
    return long.withColumn("rk", F.row_number().over(W.partitionBy("arm", "day").orderBy(*stable_order("s"))))


def daily_capacity(pool: DataFrame, scores: tuple[str, ...], ks: tuple[int, ...]) -> DataFrame:
    """arm, k, n_days, found, budget (inspections that took place), precision, recall, f1 with a budget of k a day."""
    ranked = daily_ranks(pool, scores)
    total = pool.agg(F.sum(F.col("hidden").cast("long")).alias("positives"), F.count_distinct("day").alias("n_days"))
    spent = ranked.where(F.col("rk") <= max(ks)).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rk <= k")
    sums = spent.groupBy("arm", "k").agg(F.sum(F.col("hidden").cast("long")).alias("found"), F.count(F.lit(1)).alias("budget")).crossJoin(F.broadcast(total))
    out = sums.select("arm", "k", "n_days", "found", "budget", share(F.col("found"), F.col("budget")).alias("precision"), share(F.col("found"), F.col("positives")).alias("recall"))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def strata_found_at(pool: DataFrame, score: str, stratum: str, ks: tuple[int, ...]) -> DataFrame:
    """stratum, k, found, recall: global order, numerator and denominator by stratum."""
    totals = pool.groupBy(stratum).agg(F.sum(F.col("hidden").cast("long")).alias("positives"))
    head = top(pool.select("row_ix", "hidden", stratum, F.col(score).alias("s")), max(ks), stable_order("s"))
    found = head.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("hidden AND rk <= k").groupBy(stratum, "k").agg(F.count(F.lit(1)).alias("found"))
    spine = totals.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return spine.join(found, [stratum, "k"], "left").select(stratum, "k", F.coalesce("found", F.lit(0)).alias("found"), share(F.coalesce("found", F.lit(0)), F.col("positives")).alias("recall"))


def binary_metrics(rows: DataFrame, selected: Column, positive: Column, *keys: str) -> DataFrame:
    """keys, n, positives, selected, true_positives, precision, recall, f1, prevalence, lift (null where it has no meaning)."""
    y, s = positive.cast("long"), selected.cast("long")
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"), F.sum(s).alias("selected"), F.sum(y * s).alias("true_positives"))
    out = sums.withColumn("precision", share(F.col("true_positives"), F.col("selected"))).withColumn("recall", share(F.col("true_positives"), F.col("positives")))
    prevalence = F.try_divide(F.col("positives"), F.col("n"))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("prevalence", prevalence).withColumn("lift", F.when((F.col("selected") > 0) & (F.col("positives") > 0), F.col("precision") / F.col("prevalence")))


def person_recovery(rows: DataFrame, selected: Column, positive: Column, person: str = "identity") -> DataFrame:
    """people_missed (distinct), people_found, recall: a person counts once."""
    sums = rows.agg(F.count_distinct(F.when(positive, F.col(person))).alias("people_missed"), F.count_distinct(F.when(positive & selected, F.col(person))).alias("people_found"))
    return sums.withColumn("recall", share(F.col("people_found"), F.col("people_missed")))


def first_hits(rows: DataFrame, person: str = "identity") -> DataFrame:
    """Each person's first hit by time, then event id as text, then row."""
    order = F.struct("t", F.col("event_id").cast("string").alias("e"), "row_ix")
    return rows.groupBy(person).agg(F.min_by("event_id", order).alias("first_event_id"), F.count(F.lit(1)).alias("hits"))


def threshold_sweep(rows: DataFrame, score: str, positive: str, steps: int = 100) -> DataFrame:
    """step, threshold, selected, true_positives, f1 for thresholds spaced evenly from lowest to highest score.

    A row falls below the first step above its score, so one aggregation by step and a running sum over the
    steps replaces a join of all rows with all thresholds.
    """
    ends = rows.agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.sum(F.col(positive).cast("long")).alias("positives"))
    spine = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).withColumn("threshold", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / F.lit(float(steps - 1)))
    grid = spine.groupBy("lo", "hi").agg(F.array_sort(F.collect_list("threshold")).alias("grid")).select("grid")
    last = F.size(F.filter("grid", lambda g: g <= F.col(score))) - 1
    by_step = rows.crossJoin(F.broadcast(grid)).select(last.alias("step"), F.col(positive).cast("long").alias("y")).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    running = W.partitionBy(F.lit(0)).orderBy(F.col("step").desc())
    sums = spine.join(by_step, "step", "left").select("step", "threshold", "positives", F.sum(F.coalesce("n", F.lit(0))).over(running).alias("selected"), F.sum(F.coalesce("y", F.lit(0))).over(running).alias("true_positives"))
    p, r = share(F.col("true_positives"), F.col("selected")), share(F.col("true_positives"), F.col("positives"))
    return sums.withColumn("f1", f1(p, r)).drop("positives")


def best_threshold(rows: DataFrame, score: str, positive: str, steps: int = 100) -> DataFrame:
    """threshold, f1: the first of the evenly spaced thresholds with the best F1; no row where nothing is positive."""
    sweep = threshold_sweep(rows, score, positive, steps)
    first = sweep.agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.round("f1", 12).alias("f1"), (-F.col("step")).alias("step"))).alias("best"), F.max("true_positives").alias("most"))
    return first.where("most > 0").select("best.threshold", "best.f1")


def weight_grid(pool: DataFrame, base: str, other: str, ks: tuple[int, ...], weights: int = 21) -> DataFrame:
    """w, objective: mean recall over the budgets of w * other + (1 - w) * base, both as percentiles."""
    stacked = pool.select("row_ix", "hidden", F.explode(F.sequence(F.lit(0), F.lit(weights - 1))).alias("i"), base, other)
    scored = stacked.withColumn("w", F.col("i") / (weights - 1)).withColumn("s", F.col("w") * F.col(other) + (1 - F.col("w")) * F.col(base))
    ranked = scored.withColumn("rk", F.row_number().over(W.partitionBy("i").orderBy(*stable_order("s"))))
    totals = pool.agg(F.sum(F.col("hidden").cast("long")).alias("positives"))
    hits = [F.sum((F.col("hidden") & (F.col("rk") <= k)).cast("long")) for k in ks]
    sums = ranked.where(F.col("rk") <= max(ks)).groupBy("i", "w").agg(sum(hits[1:], hits[0]).alias("found")).crossJoin(F.broadcast(totals))
    return sums.select("w", (F.col("found") / F.col("positives") / len(ks)).alias("objective"))


__all__ = ["arms", "best_threshold", "binary_metrics", "daily_capacity", "daily_ranks", "f1", "first_hits", "found_at", "person_recovery", "share", "strata_found_at", "threshold_sweep", "value_positions", "weight_grid"]
