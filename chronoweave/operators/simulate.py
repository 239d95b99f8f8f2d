"""Sequential replay of inspect-and-remove budgets, one day after the other.

A day depends on who was found before, so days are a loop; inside a day everything is distributed.  The pool is
written once, partitioned by day, and each step reads one day: rows of people found before leave through an
anti-join, then each arm and budget takes its first k rows.  What the loop carries is what was inspected,
which budgets, arms and days bound, never the pool.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import stable_order
from ..sources.shared import fresh_path
from .contracts import require_finite
from .metrics import f1, share

_FOUND = "arm string, k int, identity string, found_day timestamp"
_SEEN = "arm string, k int, day timestamp, inspected_rank int, row_ix long, event_id long, identity string, hidden boolean"


def _take(rows: DataFrame, found: list[tuple], arm: str, k: int) -> DataFrame:
    """The first k rows of a day for one arm and budget."""
    gone = [r[2] for r in found if r[0] == arm and r[1] == k]
    if gone:
        spark = rows.sparkSession
        rows = rows.join(spark.createDataFrame([(g,) for g in gone], "identity string"), "identity", "left_anti")  # broadcast only where Spark finds it small
    return rows.orderBy(*stable_order(arm)).limit(k).select(F.lit(arm).alias("arm"), F.lit(k).alias("k"), "day", F.col(arm).alias("s"), "row_ix", "event_id", "identity", "hidden")


def _replay_here(rows: list, scores: tuple[str, ...], ks: tuple[int, ...]) -> tuple[list[tuple], list[tuple]]:
    """The same steps over collected rows."""
    seen, found = [], []
    for arm in scores:
        order = sorted(rows, key=lambda r: (r["day"], r[arm] != r[arm], -r[arm] if r[arm] == r[arm] else 0.0, r["row_ix"]))
        for k in ks:
            gone: set = set()
            today: set = set()
            day, rank = None, 0
            for r in order:
                if r["day"] != day:
                    gone |= today
                    today, day, rank = set(), r["day"], 0
                if rank == k or r["identity"] in gone:
                    continue
                rank += 1
                seen.append((arm, k, day, rank, r["row_ix"], r["event_id"], r["identity"], r["hidden"]))
                if r["hidden"] and r["identity"] not in today:
                    today.add(r["identity"])
                    found.append((arm, k, r["identity"], day))
    return seen, found


def replay(pool: DataFrame, caught: DataFrame, scores: tuple[str, ...], ks: tuple[int, ...], local_rows: int = 200_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inspections, found, eligible): what was inspected in which order, who was found first when and where, and the rows that took part.

    pool: row_ix, event_id, identity, day, hidden and the scores; caught: identity, caught_time.
    Rows whose identity was officially caught strictly before the day start never take part.
    Scores that are not finite raise.  A pool of at most local_rows rows is replayed on the driver, where a day costs no job.
    """
    spark = pool.sparkSession
    require_finite(pool, *scores)
    path = fresh_path(spark, "replay")
    taking_part = pool.join(caught, "identity", "left").withColumn("eligible", F.col("caught_time").isNull() | (F.col("caught_time") >= F.col("day")))
    columns = ["row_ix", "event_id", "identity", "day", "hidden", "eligible", *scores]
    taking_part.select(*columns, F.date_format("day", "yyyy-MM-dd").alias("day_key")).write.mode("overwrite").partitionBy("day_key").parquet(path)
    stored = spark.read.parquet(path)
    if stored.count() <= local_rows:
        seen, found = _replay_here(stored.where("eligible").collect(), scores, ks)
        return spark.createDataFrame(seen, _SEEN), spark.createDataFrame(found, _FOUND), stored
    found, seen = [], []
    for (key,) in stored.select("day_key").distinct().orderBy("day_key").collect():
        rows = stored.where((F.col("day_key") == key) & F.col("eligible"))
        steps = None
        for arm in scores:
            for k in ks:
                step = _take(rows, found, arm, k)
                steps = step if steps is None else steps.unionByName(step)
        ranks: dict[tuple, int] = {}
        today: set[tuple] = set()
        for r in sorted(steps.collect(), key=lambda r: (r["arm"], r["k"], -r["s"] if r["s"] == r["s"] else float("inf"), r["row_ix"])):
            which = r["arm"], r["k"]
            ranks[which] = ranks.get(which, 0) + 1
            seen.append((*which, r["day"], ranks[which], r["row_ix"], r["event_id"], r["identity"], r["hidden"]))
            if r["hidden"] and (*which, r["identity"]) not in today:
                today.add((*which, r["identity"]))
                found.append((*which, r["identity"], r["day"]))
    inspections = spark.createDataFrame(seen, _SEEN)
    return inspections, spark.createDataFrame(found, _FOUND), stored


def summary(inspections: DataFrame, found: DataFrame, stored: DataFrame) -> DataFrame:
    """arm, k, people_found, budget, precision, recall, f1, and how many later rows the finds removed."""
    people = stored.where("eligible AND hidden").agg(F.count_distinct("identity").alias("people"))
    spent = inspections.groupBy("arm", "k").agg(F.count(F.lit(1)).alias("budget"))
    got = found.groupBy("arm", "k").agg(F.count(F.lit(1)).alias("people_found"))
    later = stored.where("eligible").join(found, "identity").where(F.col("day") > F.col("found_day"))
    gone = later.groupBy("arm", "k").agg(F.count(F.lit(1)).alias("candidates_removed"), F.sum(F.col("hidden").cast("long")).alias("hidden_removed"))
    out = spent.join(got, ["arm", "k"], "left").join(gone, ["arm", "k"], "left").fillna(0).crossJoin(F.broadcast(people))
    out = out.withColumn("precision", share(F.col("people_found"), F.col("budget"))).withColumn("recall", share(F.col("people_found"), F.col("people")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).drop("people")


def anchors(inspections: DataFrame) -> DataFrame:
    """arm, k, identity, day, event_id, inspected_rank of each person's first find."""
    first = F.min(F.struct("day", "inspected_rank", "event_id")).alias("x")
    return inspections.where("hidden").groupBy("arm", "k", "identity").agg(first).select("arm", "k", "identity", "x.day", "x.event_id", "x.inspected_rank")


def overlap(found: DataFrame, baseline: str, other: str) -> DataFrame:
    """k, side (both, only baseline, only other), people."""
    a = found.where(F.col("arm") == baseline).select("k", "identity", F.lit(True).alias("a"))
    b = found.where(F.col("arm") == other).select("k", "identity", F.lit(True).alias("b"))
    side = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "baseline_only").otherwise("other_only")
    return a.join(b, ["k", "identity"], "full").groupBy("k", side.alias("side")).agg(F.count(F.lit(1)).alias("people"))


def round_robin(cases: list[tuple[str, float, float, list[str], str]]) -> list[str]:
    """Order of a bounded case list: queues by (category, period), each giving its best case that no queue gave before.

    cases: person, rank uplift, percentile uplift, categories, period.
    """
    queues: dict[tuple[str, str], list[str]] = {}
    for person, _, _, categories, period in sorted(cases, key=lambda c: (-c[1], -c[2], c[0])):
        for category in sorted(set(categories)) or ["NONE"]:
            queues.setdefault((category, period), []).append(person)
    order: list[str] = []
    heads = dict.fromkeys(sorted(queues), 0)
    while heads:
        for key in list(heads):
            queue, at = queues[key], heads[key]
            while at < len(queue) and queue[at] in order:
                at += 1
            if at == len(queue):
                del heads[key]
            else:
                order.append(queue[at])
                heads[key] = at + 1
    return order
