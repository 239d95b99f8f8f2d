"""Ties between people: cliques of small groups, pairs of a party, samples of the tie graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cliques(groups: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """a, b, bits, w of all pairs inside groups (bit, grp, member) of least to most members; larger groups tie nobody, so work is bounded by the rows.

    A group's members are gathered only after its size is known to be small.
    """
    small = groups.groupBy("bit", "grp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size").between(least, most)).select("bit", "grp")
    members = groups.join(small, ["bit", "grp"], "left_semi").groupBy("bit", "grp").agg(F.array_sort(F.collect_list("member")).alias("all"))
    firsts = members.select("bit", "all", F.posexplode("all").alias("place", "a"))
    pairs = firsts.select("bit", "a", F.explode(F.slice("all", F.col("place") + 2, F.size("all"))).alias("b"))
    return pairs.where("a < b").groupBy("a", "b").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("w"))


def party_pairs(members: DataFrame, party: str, member: str, order: str, most: int) -> DataFrame:
    """a, b, n: how many parties count both among their first ``most`` members; a party's later members are cut, not the party."""
    first = members.withColumn("place", F.row_number().over(W.partitionBy(party).orderBy(order))).where(F.col("place") <= most)
    x, y = first.select(party, F.col(member).alias("x"), "place"), first.select(party, F.col(member).alias("y"), F.col("place").alias("later"))
    pairs = x.join(y, party).where("place < later")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def both_ways(ties: DataFrame) -> DataFrame:
    """node, other, bits, w: each tie from both its ends."""
    return ties.select(F.col("a").alias("node"), F.col("b").alias("other"), "bits", "w").union(ties.select("b", "a", "bits", "w"))


def sample(nodes: DataFrame, ends: DataFrame, roles: int, near: int, context: int, strongest: int = 5) -> DataFrame:
    """node, why: detected; at most ``roles`` with a role; at most ``near`` of the strongest neighbours of the detected; ``context`` of each stratum.

    nodes: node, stratum, detected, role.  Draws go by a hash of the node.
    """
    draw = F.md5(F.col("node").cast("string"))
    seeds = nodes.where("detected").select("node")
    with_role = nodes.where("role AND NOT detected").orderBy(draw, "node").limit(roles).select("node")
    ranked = ends.join(seeds, "node", "left_semi").withColumn("rk", F.row_number().over(W.partitionBy("node").orderBy(F.col("w").desc(), "other")))
    strong = ranked.where(F.col("rk") <= strongest).groupBy(F.col("other").alias("node")).agg(F.max("w").alias("w"))
    close = strong.join(seeds, "node", "left_anti").join(with_role, "node", "left_anti").orderBy(F.col("w").desc(), "node").limit(near).select("node")
    taken = seeds.withColumn("why", F.lit("detected")).unionByName(with_role.withColumn("why", F.lit("role"))).unionByName(close.withColumn("why", F.lit("near")))
    left = nodes.join(taken, "node", "left_anti").withColumn("rk", F.row_number().over(W.partitionBy("stratum").orderBy(draw, "node")))
    return taken.unionByName(left.where(F.col("rk") <= context).select("node", F.lit("context").alias("why")))
