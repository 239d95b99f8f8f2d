"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

1. Every partition permutes its rows locally (a sort by a hash of the row's place) and is frozen
   as Parquet in the shared folder, so that the partition and the place of a row never change again.
2. From the partitions' row counts alone the driver draws how many rows each partition sends to each
   shard: row by row a multivariate hypergeometric draw from the rows that the shards still lack.
   That matrix has one number for each map task and shard, as Spark's own shuffle bookkeeping has.
3. The first rows of a permuted partition go to shard 0, the next to shard 1, and so on: the exchange.
4. Inside a shard rows are permuted again by an independent hash.  A shard may be larger than a
   task, so it is cut into blocks of the hash range; the counts of blocks give each block's first slot.

Everything but the draw is DataFrame code; a row's columns move through one exchange.

Defined results
    null or empty texts are rows like others (payload columns are never looked at)
    repeated rows each get a slot of their own, ties do not arise: places are distinct
    an empty table gives an empty table; shards above the row count stay empty
    columns that clash with those added are an error of the caller: pick other names by ``names``
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, literal_rows, materialize

#: Local places are the low 33 bits of monotonically_increasing_id().
_PLACE = (1 << 33) - 1
_SIGN = 1 << 63


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """An exact draw; beyond numpy's range by inversion outwards from the mode."""
    if drawn == 0 or good == 0:
        return 0
    if bad == 0:
        return drawn
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p_mode = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    u, up, down, p_up, p_down = rng.random() - p_mode, mode, mode, p_mode, p_mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Row p: how many rows partition p sends to each shard.  Row sums are counts, column sums are sizes."""
    rng, left, out = np.random.default_rng(seed), list(sizes), []
    for n in counts:
        row, rest, pool = [], n, sum(left)
        for s, cap in enumerate(left):
            pool -= cap
            got = rest if s == len(left) - 1 else hypergeometric(rng, cap, pool, rest)
            row.append(got)
            rest -= got
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def shuffle_to_shards(df: DataFrame, shards: int = 16, seed: int = 7, names: tuple[str, str] = ("shard", "slot"), block_rows: int = 50_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """df's rows and columns, dealt to shards 0..shards-1 in uniformly random order: adds shard (int) and slot (long, gapless from 0)."""
    spark = df.sparkSession
    shard, slot = names
    if {shard.lower(), slot.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"df already has a column {shard} or {slot}")
    key, part, place, again, block, cuts, first, number = fresh(df, "shuffle_key", "shuffle_part", "shuffle_place", "shuffle_again", "shuffle_block", "shuffle_cuts", "shuffle_first", "shuffle_number")
    permuted = df.withColumn(key, F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).sortWithinPartitions(key).drop(key)
    frozen = materialize(permuted.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))), "permuted")

    counted = sorted((r[0], r[1]) for r in frozen.groupBy(part).agg(F.count(F.lit(1))).collect())
    total = sum(n for _, n in counted)
    matrix = communication_matrix([n for _, n in counted], shard_sizes(total, shards), seed)
    sends = [{part: p, cuts: np.cumsum(row).tolist()} for (p, _), row in zip(counted, matrix, strict=True)]
    deal = literal_rows(spark, json.dumps(sends), f"`{part}` int, `{cuts}` array<long>")
    deal = F.broadcast(deal) if 8 * len(sends) * shards <= broadcast_bytes else deal

    blocks = max(64, math.ceil(total / shards / block_rows))
    hashed = F.xxhash64(F.lit(seed + 1), F.col(part), F.col(place))
    to_block = F.least(F.lit(blocks - 1), F.floor((hashed.cast("double") + F.lit(float(_SIGN))) / F.lit(2.0 * _SIGN) * blocks)).cast("int")

    def dealt(rows: DataFrame) -> DataFrame:
        sent = rows.join(deal, part)
        shard_of = F.size(F.filter(F.col(cuts), lambda c: c <= F.col(place)))
        return sent.withColumn(shard, shard_of).withColumn(again, hashed).withColumn(block, to_block).drop(cuts)

    sizes = dealt(frozen.select(part, place)).groupBy(shard, block).agg(F.count(F.lit(1)).alias(number))
    before = W.partitionBy(shard).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(shard, block, F.coalesce(F.sum(number).over(before), F.lit(0)).alias(first))
    starts = F.broadcast(starts) if 24 * shards * blocks <= broadcast_bytes else starts

    inside = W.partitionBy(shard, block).orderBy(again, part, place)
    placed = dealt(frozen).join(starts, [shard, block]).withColumn(number, F.row_number().over(inside))
    return placed.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], F.col(shard).cast("int").alias(shard), (F.col(first) + F.col(number) - 1).cast("long").alias(slot))
