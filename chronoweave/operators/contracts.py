"""Joins and set rules that raise where rows break the contract, and audits that count instead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _repeated(rows: DataFrame, key: str) -> list:
    return [r[0] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key).orderBy(key).limit(3).collect()]


def samples(left: DataFrame, right: DataFrame, key: str, most: int = 3) -> list:
    """The smallest keys of left that right lacks."""
    return [r[0] for r in left.select(key).distinct().join(right.select(key), key, "left_anti").orderBy(key).limit(most).collect()]


def require_unique(rows: DataFrame, key: str, name: str) -> None:
    if found := _repeated(rows, key):
        raise ValueError(f"{name} has repeated {key} values: {found}")


def require_same_keys(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> None:
    for a, b, what in ((left, right, f"{names[1]} lacks"), (right, left, f"{names[1]} has unexpected")):
        if found := samples(a, b, key):
            raise ValueError(f"{what} {key} values: {found}")


def require_finite(rows: DataFrame, *columns: str) -> None:
    from ..functions.parse import is_finite

    bad = rows.agg(*[F.count_if(~is_finite(F.col(c))).alias(c) for c in columns]).first()
    if found := [c for c in columns if bad[c]]:
        raise ValueError(f"not finite: {found}")


def one_to_one(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """left and right joined where each key stands once on either side and on both; anything else raises."""
    for rows, name in ((left, names[0]), (right, names[1])):
        require_unique(rows, key, name)
    require_same_keys(left, right, key, names)
    return left.join(right, key)


def join_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side, keys, repeated: keys on both sides and on one only, and how many of them stand more than once on a side."""
    a, b = (rows.groupBy(F.col(key).alias(k)).agg(F.count(F.lit(1)).alias(n)) for rows, k, n in ((left, "a", "na"), (right, "b", "nb")))
    side = F.when(F.col("a").isNull(), "right_only").when(F.col("b").isNull(), "left_only").otherwise("both")
    twice = F.greatest(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))) > 1
    return a.join(b, F.col("a") == F.col("b"), "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("keys"), F.count_if(twice).alias("repeated"))


def frozen_with_oracle(frozen: DataFrame, oracle: DataFrame, person: str = "identity") -> DataFrame:
    """Frozen rows in their order (row_ix) with what was true; ids once on both sides, persons equal."""
    joined = one_to_one(frozen, oracle.withColumnRenamed(person, "oracle_person"), "event_id", ("frozen", "oracle"))
    wrong = [r[0] for r in joined.where(~F.col(person).eqNullSafe(F.col("oracle_person"))).select("event_id").orderBy("event_id").limit(3).collect()]
    if wrong:
        raise ValueError(f"the oracle has other persons for events: {wrong}")
    return joined.drop("oracle_person").orderBy("row_ix")


def exactly_once(people: DataFrame, cohorts: DataFrame, key: str = "identity") -> DataFrame:
    """rule, n: people in no cohort, in several, and members of cohorts that are no people."""
    places = cohorts.groupBy(key).agg(F.count(F.lit(1)).alias("places"))
    joined = people.select(key).distinct().withColumn("known", F.lit(True)).join(places, key, "full_outer")
    rules = {"uncovered": F.col("places").isNull(), "covered_twice": F.col("known") & (F.col("places") > 1), "unknown": F.col("known").isNull()}
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(rule, F.lit(False)).alias("hit")) for name, rule in rules.items()])).alias("x")
    return joined.select(cells).groupBy("x.rule").agg(F.count_if("x.hit").alias("n"))
