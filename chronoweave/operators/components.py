"""Connected components and what is computed from them.

Edges are contracted by each node's smallest neighbour until none is left.  Every round is written to the
shared folder, so lineage stays short and a lost executor costs one round at most.  With ``keys`` (a day,
say) many graphs are worked on in the same rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialize


def _local(rows: list[tuple]) -> list[tuple]:
    """(keys, node, root) by union-find over (keys, u, v)."""
    parent: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for *k, u, v in rows:
        a, b = find((*k, u)), find((*k, v))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(*x, find(x)[-1]) for x in list(parent)]


def connected(edges: DataFrame, nodes: DataFrame | None = None, keys: tuple[str, ...] = (), local_edges: int = 200_000) -> DataFrame:
    """keys, node, root of all nodes of edges (u, v) and of nodes (keys, node); root is the smallest node of the component.

    At most local_edges distinct edges are united on the driver: a dozen small jobs would take longer than all the work.
    """
    k = list(keys)
    left = materialize(edges.where("u <> v").select(*k, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    if left.count() <= local_edges:
        fields = [left.schema[c] for c in k] + [T.StructField(n, left.schema["u"].dataType) for n in ("node", "root")]
        labels = left.sparkSession.createDataFrame(_local([tuple(r) for r in left.collect()]), T.StructType(fields))
    shrinking = labels is None
    while shrinking and not left.isEmpty():
        both = left.unionByName(left.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        step = materialize(both.groupBy(*k, F.col("u").alias("node")).agg(F.min("v").alias("m")).select(*k, "node", F.least("node", "m").alias("next")), "hooks")
        a, b = step.select(*k, F.col("node").alias("u"), F.col("next").alias("x")), step.select(*k, F.col("node").alias("v"), F.col("next").alias("y"))
        left = materialize(left.join(a, [*k, "u"]).join(b, [*k, "v"]).where("x <> y").select(*k, F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        if labels is None:
            labels = step.select(*k, "node", F.col("next").alias("root"))
        else:
            moved = step.select(*k, F.col("node").alias("root"), "next")
            labels = labels.join(moved, [*k, "root"], "left").select(*k, "node", F.coalesce("next", "root").alias("root"))
        labels = materialize(labels, "labels")
    if labels is None:
        labels = left.select(*k, F.col("u").alias("node"), F.col("u").alias("root"))
    if nodes is not None:
        labels = nodes.select(*k, "node").distinct().join(labels, [*k, "node"], "left").select(*k, "node", F.coalesce("root", "node").alias("root"))
    smallest = labels.groupBy(*k, "root").agg(F.min("node").alias("least_node"))
    return labels.join(smallest, [*k, "root"]).select(*k, "node", F.col("least_node").alias("root"))


def spans(travel: DataFrame, home: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, root, size, households: size of the node's component and how many residence components it spans."""
    k = list(keys)
    both = travel.join(home.select(*k, "node", F.col("root").alias("home_root")), [*k, "node"])
    sums = both.groupBy(*k, "root").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("home_root").alias("households"))
    return travel.join(sums, [*k, "root"]).select(*k, "node", "root", "size", "households")


def distances(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """node, distance (0 .. hops) from the nearest source; one frontier join a hop."""
    pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    reached = sources.select("node").distinct().withColumn("distance", F.lit(0))
    for hop in range(1, hops + 1):
        step = pairs.join(reached.where(F.col("distance") == hop - 1), F.col("u") == F.col("node")).select(F.col("v").alias("node")).distinct()
        reached = reached.unionByName(step.join(reached, "node", "left_anti").withColumn("distance", F.lit(hop)))
    return reached


def group_distances(members: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """As distances, over memberships (kind, grp, node): a hop goes from nodes to their groups and from groups to their nodes, so no pair is made."""
    ties = members.where("kind <> 2").select("kind", "grp", "node")
    reached = materialize(sources.select("node").distinct().withColumn("distance", F.lit(0)), "reached")
    for hop in range(1, hops + 1):
        front = reached.where(F.col("distance") == hop - 1).select("node")
        groups = ties.join(front, "node", "left_semi").select("kind", "grp").distinct()
        step = ties.join(groups, ["kind", "grp"], "left_semi").select("node", F.lit(hop).alias("distance"))
        reached = materialize(reached.unionByName(step).groupBy("node").agg(F.min("distance").alias("distance")), "reached")
    return reached


def _local_bridges(rows: list[tuple]) -> list[tuple]:
    """Bridges of distinct pairs (u, v) by depth-first numbers, without recursion."""
    near: dict = {}
    for u, v in rows:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    number: dict = {}
    low: dict = {}
    out = []
    for start in near:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        stack = [(start, None, iter(near[start]))]
        while stack:
            node, parent, rest = stack[-1]
            for other in rest:
                if other == parent:
                    continue
                if other in number:
                    low[node] = min(low[node], number[other])
                else:
                    number[other] = low[other] = len(number)
                    stack.append((other, node, iter(near[other])))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if low[node] > number[parent]:
                        out.append((min(node, parent), max(node, parent)))
    return out


def bridges(edges: DataFrame, local_edges: int = 200_000) -> DataFrame:
    """(u, v) with u < v of pairs whose removal disconnects their component.

    At most local_edges distinct pairs are finished on the driver.  Beyond, breadth-first trees are grown level by level, however
    deep; every pair outside of the trees gets a 64-bit label, known to both its ends.  The exclusive or of the labels in a
    subtree is zero exactly when no such pair leaves it (up to 2^-64), and then the edge to the parent is a bridge.  Subtrees
    are summed level by level: no component is gathered in a task.
    """
    pairs = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "pairs")
    if pairs.count() <= local_edges:
        return pairs.sparkSession.createDataFrame(_local_bridges([tuple(r) for r in pairs.collect()]), pairs.schema)
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    roots = connected(pairs, local_edges=local_edges).where("node = root").select("node").withColumn("parent", F.lit(None).cast(pairs.schema["u"].dataType)).withColumn("level", F.lit(0))
    levels = [materialize(roots, "level")]
    while True:
        front, before = levels[-1], levels[-2] if len(levels) > 1 else None
        grown = both.join(front.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node"), F.col("u").alias("parent")).groupBy("node").agg(F.min("parent").alias("parent")).join(front.select("node"), "node", "left_anti")
        if before is not None:  # neighbours of a level lie in the level before it, in it, or behind it
            grown = grown.join(before.select("node"), "node", "left_anti")
        grown = materialize(grown.withColumn("level", F.lit(len(levels))), "level")
        if grown.isEmpty():
            break
        levels.append(grown)
    tree = levels[0]
    for grown in levels[1:]:
        tree = tree.unionByName(grown)
    kept = tree.where("parent IS NOT NULL").select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))
    labelled = pairs.join(kept, ["u", "v"], "left_anti").withColumn("x", F.xxhash64("u", "v", F.lit(17)))
    ends = labelled.select(F.col("u").alias("node"), "x").unionByName(labelled.select(F.col("v").alias("node"), "x"))
    own = materialize(ends.groupBy("node").agg(F.expr("bit_xor(x)").alias("x")), "labels")
    done, carried = None, None
    for level in levels[:0:-1]:
        here = level.join(own, "node", "left").select("node", "parent", F.coalesce("x", F.lit(0)).alias("x"))
        if carried is not None:
            here = here.join(carried, "node", "left").withColumn("x", F.col("x").bitwiseXOR(F.coalesce("below", F.lit(0)))).drop("below")
        here = materialize(here, "subtrees")
        carried = here.groupBy(F.col("parent").alias("node")).agg(F.expr("bit_xor(x)").alias("below"))
        cut = here.where("x = 0").select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))
        done = cut if done is None else done.unionByName(cut)
    return done if done is not None else pairs.where(F.lit(False))


def group_bridges(members: DataFrame, local_edges: int = 200_000) -> DataFrame:
    """As bridges, of all pairs inside the groups of members (grp, node; distinct), without making the pairs.

    In a group of three or more every pair lies on a cycle, so none is a bridge, and a ring of the members keeps the rest as it is:
    one row for each member.  Only groups of two can give bridges; without any there are none.
    """
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"), F.max("node").alias("last")).where("size > 1")
    sizes = materialize(sizes, "sizes")
    couples = sizes.where("size = 2").select(F.col("first").alias("u"), F.col("last").alias("v")).distinct()
    if couples.isEmpty():
        return couples
    following = F.lead("node").over(W.partitionBy("grp").orderBy("node"))
    ring = members.join(sizes.where("size > 2"), "grp").select(F.col("node").alias("u"), F.coalesce(following, "first").alias("v"))
    return bridges(couples.unionByName(ring), local_edges)
