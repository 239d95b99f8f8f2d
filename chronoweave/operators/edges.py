"""The timestamped multigraph: co-travel, residence, shared plate and hot shared plate.

Self-joins keep both directions and all multiplicities; a row is available from the later of its two
times, and used only strictly after that.  Degrees need no join at all: see ``degrees``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import framed_hash, iso_utc
from ..sources.shared import materialize

RELATIONS = ("COTRAVEL", "RESIDENCE", "SHARED_PLATE", "SHARED_PLATE_HOT")


def _pairs(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """Ordered pairs of different identities that share a key; greatest() skips null times as the contract asks."""
    a = rows.select(key, F.col("identity").alias("u"), F.col("t").alias("tu"), *more)
    b = rows.select(key, F.col("identity").alias("v"), F.col("t").alias("tv"))
    return a.join(b, key).where("u <> v").withColumn("avail_time", F.greatest("tu", "tv")).where("avail_time IS NOT NULL")


def cotravel(rows: DataFrame, key: str = "co_key") -> DataFrame:
    return _pairs(rows, key).select("u", "v", "avail_time", F.lit(0).alias("rel"), F.lit(RELATIONS[0]).alias("edge_type"))


def residence(households: DataFrame, key: str = "household") -> DataFrame:
    return _pairs(households.where(F.col(key).isNotNull()), key).select("u", "v", "avail_time", F.lit(1).alias("rel"), F.lit(RELATIONS[1]).alias("edge_type"))


def shared_plate(rows: DataFrame, hot: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """hot: key, hot_time.  A pair at or after its plate's first visible seizure is hot (the one deliberate >=)."""
    pairs = _pairs(rows.where(F.col(key).isNotNull()), key).join(hot, key, "left")
    is_hot = F.coalesce(F.col("avail_time") >= F.col("hot_time"), F.lit(False))
    return pairs.select("u", "v", "avail_time", F.when(is_hot, 3).otherwise(2).alias("rel"), F.when(is_hot, RELATIONS[3]).otherwise(RELATIONS[2]).alias("edge_type"))


def first_seizure(events: DataFrame, key: str = "vehicle_id") -> DataFrame:
    return events.where(F.col("seizure") & F.col("label_available").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("label_available").alias("hot_time"))


def multigraph(events: DataFrame, households: DataFrame) -> DataFrame:
    """u, v, avail_time, rel, edge_type of all four relations."""
    return cotravel(events).unionByName(residence(households)).unionByName(shared_plate(events, first_seizure(events)))


def active(edges: DataFrame, before: Column) -> DataFrame:
    """Edges available strictly before a moment."""
    return edges.where(F.col("avail_time") < before)


def provenance(edges: DataFrame) -> DataFrame:
    """Adds occurrence (number among equal rows, from 0), stamp, source_row_id and canonical_pair_group_id, as hashes of length-framed texts; nulls raise.

    Edges may come counted, as timed_pairs makes them: with n, each pair once, without nulls.  Then both directions come out, side by
    side; they share the pair's texts and hash, and columns that stay as they are keep the dealing by cell or u, so nothing moves.

    Equal rows are counted and numbered by a sequence: no window over the key, so a hot key is no hot task.
    """
    halves = "n" in edges.columns
    for column in () if halves else ("u", "v", "avail_time", "edge_type"):
        error = F.raise_error(F.lit(f"edge provenance cannot be made from a null {column}"))
        edges = edges.withColumn(column, F.coalesce(F.col(column), error.cast(edges.schema[column].dataType)))
    counted = edges.groupBy(*["cell"] * halves, "u", "v", "avail_time", "rel", "edge_type").agg((F.sum("n") if halves else F.count(F.lit(1))).alias("n"))
    pair_id = F.concat(F.lit("pair:"), framed_hash(F.least("u", "v"), F.greatest("u", "v"), F.col("edge_type")))
    named = counted.withColumns({"stamp": iso_utc(F.col("avail_time")), "canonical_pair_group_id": pair_id})
    rows = named.withColumn("occurrence", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    if halves:
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        rows = rows.withColumn("way", F.explode(ways)).withColumns({"u": F.col("way.u"), "v": F.col("way.v")})
    row_id = F.concat(F.lit("edge:"), framed_hash(F.col("u"), F.col("v"), F.col("stamp"), F.col("edge_type"), F.col("occurrence").cast("string")))
    return rows.select("u", "v", "avail_time", "rel", "edge_type", "occurrence", "stamp", row_id.alias("source_row_id"), "canonical_pair_group_id")


def stars(rows: DataFrame, key: str) -> DataFrame:
    """u, v, avail_time: each identity of a group tied to the group's earliest one, from its own first time on.

    As of any moment these rows connect what all pairs of the group connect, with one row for each member instead of one for
    each pair.
    """
    first = rows.where(F.col(key).isNotNull() & F.col("t").isNotNull()).groupBy(key, "identity").agg(F.min("t").alias("t"))
    centre = first.groupBy(key).agg(F.min(F.struct("t", "identity")).alias("c"))
    tied = first.join(centre, key).where(F.col("identity") != F.col("c.identity"))
    return tied.select(F.col("c.identity").alias("u"), F.col("identity").alias("v"), F.col("t").alias("avail_time"))


#: Kinds of memberships: relations 0 and 1, plates before they are hot, and all plates (hot pairs are the last less the third).
KINDS = (0, 1, 2, 9)


def memberships(events: DataFrame, households: DataFrame, before: Column) -> DataFrame:
    """kind, grp, node, n: how often a node stands in a group as of a moment.  The pairs of the multigraph follow from these counts."""
    seen = events.where((F.col("t") < before) & F.col("identity").isNotNull())
    plates = seen.where(F.col("vehicle_id").isNotNull())
    cold = plates.join(first_seizure(events), "vehicle_id", "left").where(F.col("hot_time").isNull() | (F.col("t") < F.col("hot_time")))
    home = households.where(F.col("household").isNotNull() & F.col("identity").isNotNull() & (F.col("t") < before))
    out = None
    for kind, rows, key in ((0, seen, "co_key"), (1, home, "household"), (2, cold, "vehicle_id"), (9, plates, "vehicle_id")):
        part = rows.groupBy(F.lit(kind).alias("kind"), F.col(key).alias("grp"), F.col("identity").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def group_ties(seen: DataFrame, keys: dict[int, Column]) -> DataFrame:
    """kind, grp, node: who stands in which group of each kind, out of one pass over the rows; enough for hops, which need no counts."""
    cells = F.array(*[F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("grp")) for kind, key in keys.items()])
    rows = seen.where(F.col("identity").isNotNull()).select(F.explode(cells).alias("x"), F.col("identity").alias("node"))
    return rows.select("x.kind", "x.grp", "node").where("grp IS NOT NULL").distinct()


def target(members: DataFrame) -> DataFrame:
    """node: the smallest one that travels with another, null if there is none."""
    groups = members.where("kind = 0 AND grp IS NOT NULL AND node IS NOT NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("node"))
    return groups.where("size > 1").agg(F.min("node").alias("node"))


def pairs_between(members: DataFrame, left: DataFrame | None = None, right: DataFrame | None = None, both_ways: bool = True) -> DataFrame:
    """u, v, rel, w: how many rows of the multigraph each pair of the nodes left and right has (all nodes without them); each pair once, u < v, unless both_ways.

    Memberships are cut to the nodes before they meet, and meet once for each group, however often a node stands in it.
    """
    a, b = (members if nodes is None else members.join(nodes.select("node"), "node", "left_semi") for nodes in (left, right))
    met = a.select("kind", "grp", F.col("node").alias("u"), F.col("n").alias("nu")).join(b.select("kind", "grp", F.col("node").alias("v"), F.col("n").alias("nv")), ["kind", "grp"])
    sums = met.where("u <> v" if both_ways else "u < v").groupBy("u", "v").agg(*[F.sum(F.when(F.col("kind") == k, F.col("nu") * F.col("nv")).otherwise(0.0)).alias(f"w{k}") for k in KINDS])
    counts = [F.col("w0"), F.col("w1"), F.col("w2"), F.col("w9") - F.col("w2")]
    rows = sums.select("u", "v", F.explode(F.array(*[F.struct(F.lit(r).alias("rel"), w.alias("w")) for r, w in enumerate(counts)])).alias("x"))
    return rows.select("u", "v", "x.rel", "x.w").where("w > 0.5")


def travel_groups(events: DataFrame, before: Column, key: str = "co_key") -> DataFrame:
    """grp, node: who stands in which group of co-travel as of a moment."""
    seen = events.where((F.col("t") < before) & F.col(key).isNotNull() & F.col("identity").isNotNull())
    return seen.select(F.col(key).alias("grp"), F.col("identity").alias("node")).distinct()


#: Rows of a table of memberships that each executor may hold whole; beyond, rows meet in cells.
HELD_ROWS = 2_000_000
#: Pairs, both directions counted, that one task makes, about; in cells, which cost copies of the rows, more.
TASK_PAIRS, CELL_PAIRS = 1_000_000, 8_000_000


def timed_rows(events: DataFrame, households: DataFrame, before: Column) -> DataFrame:
    """rel (0, 1, 2), grp, node, t, hot_time, n: equal observations of a node in a group as of a moment, counted."""
    seen = events.where((F.col("t") < before) & F.col("identity").isNotNull())
    plates = seen.where(F.col("vehicle_id").isNotNull()).join(first_seizure(events), "vehicle_id", "left")
    home = households.where(F.col("household").isNotNull() & F.col("identity").isNotNull() & (F.col("t") < before))
    cold = F.lit(None).cast("timestamp")
    out = None
    for rel, rows, key, hot in ((0, seen, "co_key", cold), (1, home, "household", cold), (2, plates, "vehicle_id", F.col("hot_time"))):
        part = rows.groupBy(F.lit(rel).alias("rel"), F.col(key).alias("grp"), F.col("identity").alias("node"), "t", hot.alias("hot_time")).agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.where("grp IS NOT NULL")


def meet(rows: DataFrame, left: list, right: list, held_rows: int | None = None) -> DataFrame:
    """rows joined with themselves on (rel, grp), each two different nodes (the first of left and of right) in one direction; cell: all that two nodes share is in one, and in one task.

    Pairs are not shuffled.  Up to held_rows rows, each executor holds the right side whole, and rows are dealt by the left node.
    Beyond, nodes are dealt to buckets, and each two buckets meet in a cell, so a row moves once for each bucket, and a large
    group is spread over all cells.
    """
    sizes = rows.groupBy("rel", "grp").agg(F.count(F.lit(1)).cast("double").alias("size")).agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.col("size")).alias("pairs")).first()
    least, pairs = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), sizes["pairs"] or 0
    a, b = rows.select("rel", "grp", *left), rows.select("rel", "grp", *right)
    u, v = a.columns[2], b.columns[2]
    if (sizes["n"] or 0) <= (HELD_ROWS if held_rows is None else held_rows):
        dealt = a.withColumn("cell", F.lit(0)).repartition(max(least, int(pairs // TASK_PAIRS) + 1), u)
        return dealt.join(F.broadcast(b), ["rel", "grp"]).where(F.col(u) < F.col(v))
    n = math.isqrt(int(pairs // CELL_PAIRS)) + 1
    bucket, other = F.pmod(F.hash("node"), F.lit(n)), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    copies = rows.withColumn("other", other).withColumn("cell", F.least(bucket, "other") * n + F.greatest(bucket, "other")).drop("other")
    # the cell i * n + j has left nodes of the bucket i and right ones of j, i <= j; a join would deal by the groups too
    ends = [F.collect_list(F.when(at, F.struct(*side))).alias(name) for name, at, side in (("l", bucket == F.floor(F.col("cell") / n), left), ("r", bucket == F.col("cell") % n, right))]
    groups = copies.repartition(max(least, n * (n + 1) // 2), "cell").groupBy("cell", "rel", "grp").agg(*ends)
    met = groups.withColumn("l", F.explode("l")).withColumn("r", F.explode("r")).select("cell", "rel", "grp", "l.*", "r.*")
    return met.where((F.col("cell") % (n + 1) != 0) | (F.col(u) < F.col(v)))


def timed_pairs(rows: DataFrame, held_rows: int | None = None) -> DataFrame:
    """cell, u, v, avail_time, rel, edge_type, n out of timed_rows: the rows of the multigraph in one of both directions, those of the same observations counted."""
    found = meet(rows, [F.col("node").alias("u"), F.col("t").alias("tu"), "hot_time", F.col("n").alias("nu")], [F.col("node").alias("v"), F.col("t").alias("tv"), F.col("n").alias("nv")], held_rows)
    found = found.select("cell", "u", "v", F.greatest("tu", "tv").alias("avail_time"), "hot_time", "rel", (F.col("nu") * F.col("nv")).alias("n"))
    rel = F.when(F.coalesce(F.col("avail_time") >= F.col("hot_time"), F.lit(False)), 3).otherwise(F.col("rel"))
    typed = found.select("cell", "u", "v", "avail_time", rel.alias("rel"), "n")
    name = F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("rel") + 1)
    return typed.select("cell", "u", "v", "avail_time", "rel", name.alias("edge_type"), "n")


def canonical(rows: DataFrame, near: DataFrame, held_rows: int | None = None) -> DataFrame:
    """a, b, rel, n, first, hop: each pair of near nodes (node, distance) and relation once, out of timed_rows; n counts both directions.

    A group's members meet once, with how often and when they were first there cold and hot.  The first moment of a hot pair is the
    later of both first times, or, where that is cold, the earliest hot observation of either.
    """
    hot = F.coalesce(F.col("t") >= F.col("hot_time"), F.lit(False))
    held = rows.groupBy("rel", "grp", "node").agg(F.sum("n").alias("n"), F.sum(F.when(hot, 0).otherwise(F.col("n"))).alias("cold"), F.min("t").alias("first"), F.min(F.when(hot, F.col("t"))).alias("hot")).join(near, "node")
    held = materialize(held, "held")
    columns = ("n", "cold", "first", "hot", "distance")
    met = meet(held, [F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns]], [F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns]], held_rows)
    later, both_cold = F.greatest("first_a", "first_b"), (F.col("cold_a") > 0) & (F.col("cold_b") > 0)
    every, cold = F.col("n_a") * F.col("n_b"), F.col("cold_a") * F.col("cold_b")
    found = met.groupBy("cell", "a", "b", "rel").agg(
        F.sum(2 * cold).alias("n"),
        F.sum(2 * (every - cold)).alias("n_hot"),
        F.min(F.when(both_cold, later)).alias("first"),
        F.min(F.when(every > cold, F.when(both_cold, F.least("hot_a", "hot_b")).otherwise(later))).alias("first_hot"),
        F.max(F.greatest("distance_a", "distance_b")).alias("hop"),
    )
    kinds = F.array(F.struct("rel", "n", "first"), F.struct(F.lit(3).alias("rel"), F.col("n_hot").alias("n"), F.col("first_hot").alias("first")))
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return found.select(*ends, "hop", F.explode(kinds).alias("x")).where("x.n > 0").select("a", "b", "x.rel", "x.n", "x.first", "hop")


def rows_of(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n: rows of the multigraph that start at each of the nodes."""
    every = members.where("kind <> 2")
    whole = every.groupBy("kind", "grp").agg(F.sum("n").alias("n_all"))
    own = every.join(nodes.select("node"), "node", "left_semi").join(whole, ["kind", "grp"])
    return own.groupBy("node").agg(F.sum(F.col("n") * (F.col("n_all") - F.col("n"))).cast("long").alias("n")).where("n > 0")


def _products(rows: DataFrame, key: str) -> DataFrame:
    """identity, n: rows of the self-join on key that touch the identity, from counts: twice n_own * (n_all - n_own)."""
    own = rows.groupBy(key, "identity").agg(F.count(F.lit(1)).alias("n_own"))
    whole = own.groupBy(key).agg(F.sum("n_own").alias("n_all"))
    return own.join(whole, key).groupBy("identity").agg(F.sum(2 * F.col("n_own") * (F.col("n_all") - F.col("n_own"))).alias("n"))


def degrees(events: DataFrame, households: DataFrame, before: Column) -> DataFrame:
    """identity, deg_0 .. deg_3 as of a moment, without any self-join.

    A pair of observations is available before T when both are, so the pairs of a node in a group are the product
    of two counts; those of a hot plate before it became hot are the same product at the earlier of T and that time.
    """
    seen = events.where((F.col("t") < before) & F.col("identity").isNotNull())
    plates = seen.where(F.col("vehicle_id").isNotNull())
    cold = plates.join(first_seizure(events), "vehicle_id", "left").where(F.col("hot_time").isNull() | (F.col("t") < F.col("hot_time")))
    parts = [
        _products(seen, "co_key").withColumn("rel", F.lit(0)),
        _products(households.where(F.col("household").isNotNull() & F.col("identity").isNotNull() & (F.col("t") < before)), "household").withColumn("rel", F.lit(1)),
        _products(cold, "vehicle_id").withColumn("rel", F.lit(2)),
        _products(plates, "vehicle_id").withColumn("rel", F.lit(9)),
    ]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    per = [F.sum(F.when(F.col("rel") == r, F.col("n")).otherwise(0)) for r in (0, 1, 2, 9)]
    return long.groupBy("identity").agg(per[0].alias("deg_0"), per[1].alias("deg_1"), per[2].alias("deg_2"), (per[3] - per[2]).alias("deg_3"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Each row in both directions, with its provenance; mirrored rows say so."""
    return edges.withColumn("mirror", F.lit(False)).unionByName(edges.withColumns({"u": F.col("v"), "v": F.col("u"), "mirror": F.lit(True)}))
