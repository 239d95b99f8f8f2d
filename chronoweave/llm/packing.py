"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits into one sequence.  The program asks for the
fewest configurations that cover the histogram of lengths.  It is solved by multiplicative weights: a
length's price falls exponentially with the share of its demand that is covered, and the configuration
worth most at these prices comes from a knapsack dynamic program over the capacity.  Most pricings look
at the lengths of the highest price for their size only; every hundredth looks at all, and gives a dual bound:
prices divided by the worth of the best configuration are feasible for the dual program.

The solution is scaled to cover no length twice and rounded: full configurations first, each as often
as the solution says, at least once, as far as pieces are left.  The program is solved again for what is left,
until a round places nearly nothing; while much is left, configurations that are a little less full may then be
used too.  Of equally full ones those of few pieces
come first, which leaves short pieces to fill up with.  The last pieces, under a tenth and at most 100,000, are placed
best-fit decreasing.

The driver sees one number for each length, at most ``capacity`` of them, whatever the corpus.  The
result is a table of configurations and how often each is used.  A piece finds its place from its
length and its number among the pieces of this length alone, so no sequence is ever gathered in a task.

Defined results
    null text is empty: one piece of one id, the closing one
    repeated rows and equal ids are packed one by one
    very long texts are cut at multiples of the capacity; all other documents stay whole
    an empty table gives an empty table; extra columns of df are not read
"""

from __future__ import annotations

import json
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import document_pieces
from .common import literal_rows, materialize


def knapsack(prices: np.ndarray, demand: np.ndarray, lengths: list[int]) -> tuple[dict[int, int], float]:
    """The configuration of the highest total price out of these lengths, no more of each than demand has, and its price; capacity len(prices) - 1."""
    capacity = len(prices) - 1
    parts = []  # times 1, 2, 4, ... of a length, so that each number of it can be taken
    for length in lengths:
        left, times = min(int(demand[length]), capacity // length), 1
        while left:
            times = min(times, left)
            parts.append((length, times))
            left, times = left - times, 2 * times
    best, taken = np.zeros(capacity + 1), np.zeros((len(parts), capacity + 1), bool)
    for i, (length, times) in enumerate(parts):
        size = length * times
        other = best[: capacity + 1 - size] + prices[length] * times
        np.greater(other, best[size:], out=taken[i, size:])
        best[size:] = np.maximum(best[size:], other)
    out: Counter[int] = Counter()
    room = capacity
    for i in range(len(parts) - 1, -1, -1):
        if taken[i, room]:
            length, times = parts[i]
            out[length] += times
            room -= length * times
    return dict(out), float(best[capacity])


def fractional(demand: np.ndarray, rounds: int, some: int, draw: np.random.Generator, rate: float = 6.0) -> tuple[dict[tuple, float], float]:
    """configuration -> how often, by multiplicative weights, and the dual bound; configurations are sorted tuples of (length, times).

    some: how many lengths a partial pricing looks at.
    """
    capacity = len(demand) - 1
    present = np.flatnonzero(demand)
    need, place = demand[present].astype(float), {int(length): i for i, length in enumerate(present)}
    covered, used, bound = np.zeros(len(present)), Counter(), 0.0
    for number in range(rounds):
        low = covered.min()
        if low >= 1:
            break
        density = np.exp(-rate * np.minimum(covered - low, 50 / rate))
        prices = np.zeros(capacity + 1)
        prices[present] = present / capacity * density
        whole = number % 100 == 0 or len(present) <= some
        looked_at = present if whole else present[np.argpartition(-density * (1 + 0.01 * draw.random(len(present))), some)[:some]]
        chosen, worth = knapsack(prices, demand, sorted(looked_at.tolist(), reverse=True))
        if whole:
            bound = max(bound, float((prices[present] * need).sum()) / worth)
        at, times = np.array([place[length] for length in chosen]), np.array(list(chosen.values()))
        step = float((need[at] / times).min()) / 2
        used[tuple(sorted(chosen.items()))] += step
        covered[at] += times * step / need[at]
    most = float(covered.max(initial=0.0)) or 1.0
    return {c: x / most for c, x in used.items()}, bound


def best_fit_decreasing(left: np.ndarray) -> Counter[tuple]:
    """The rest of the pieces, longest first, each into the fullest sequence that still takes it."""
    capacity = len(left) - 1
    bins: dict[int, list[list[int]]] = {}
    open_free = 0
    for length in range(capacity, 0, -1):
        for _ in range(int(left[length])):
            rest = open_free >> length
            free = length + (rest & -rest).bit_length() - 1 if rest else capacity
            if rest:
                content = bins[free].pop()
                if not bins[free]:
                    open_free &= ~(1 << free)
            else:
                content = []
            content.append(length)
            bins.setdefault(free - length, []).append(content)
            open_free |= 1 << (free - length)
    return Counter(tuple(sorted(Counter(content).items())) for group in bins.values() for content in group)


def solve(histogram: dict[int, int], capacity: int, rounds: int = 200, some: int = 160, most_by_hand: int = 100_000) -> tuple[list[tuple[tuple, int]], dict]:
    """Configurations and how often each is used, which together hold exactly the histogram's pieces; and a report.

    The report: pieces, sequences, bound (no packing has fewer sequences), by_program and by_best_fit (pieces that each of the two placed).
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    out: Counter[tuple] = Counter()
    pieces, full = int(left.sum()), int(left[capacity])
    if full:
        out[((capacity, 1),)] = full  # these fill a sequence alone in every packing
        left[capacity] = 0
    draw, bound, waste = np.random.default_rng(0), None, 0
    while before := int(left.sum()):
        solved, low = fractional(left, min(rounds, 2 * int(np.count_nonzero(left))), some, draw)
        bound = low if bound is None else bound
        for config, x in sorted(solved.items(), key=lambda c: (-sum(length * k for length, k in c[0]), sum(k for _, k in c[0]), -c[1], c[0])):
            if capacity - sum(length * k for length, k in config) > waste:
                break
            n = min([max(1, math.floor(x + 1e-9)), *(int(left[length]) // k for length, k in config)])
            if n > 0:
                out[config] += n
                for length, k in config:
                    left[length] -= n * k
        if before - int(left.sum()) < before / 20:
            if before < (pieces - full) / 10 and before <= most_by_hand:
                break
            waste = max(1, 4 * waste)
    rest = int(left.sum())
    out.update(best_fit_decreasing(left))
    sequences = sum(out.values())
    return sorted(out.items()), {"pieces": pieces, "sequences": sequences, "bound": math.ceil(full + (bound or 0.0) - 1e-6), "by_program": pieces - rest, "by_best_fit": rest}


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """The configurations of solve."""
    return solve(histogram, capacity)[0]


def layout(configurations: list[tuple[tuple, int]]) -> list[dict]:
    """By length: where the numbers of its pieces begin in each configuration, and that configuration's place."""
    by_length: dict[int, list] = {}
    seen: Counter[int] = Counter()
    first = 0
    for config, times in configurations:
        offset = 0
        for length, each in config:
            by_length.setdefault(length, []).append((seen[length], each, first, offset))
            seen[length] += each * times
            offset += length * each
        first += times
    return [{"length": length, "begins": [r[0] for r in rows], "each": [r[1] for r in rows], "firsts": [r[2] for r in rows], "offsets": [r[3] for r in rows]} for length, rows in sorted(by_length.items())]


def pack_pieces(pieces: DataFrame, capacity: int, bucket_rows: int = 20_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32, ...).  pieces must not change between reads."""
    spark = pieces.sparkSession
    counted = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    table = literal_rows(spark, json.dumps(layout(plan(counted, capacity))), "length long, begins array<long>, each array<long>, firsts array<long>, offsets array<long>")
    buckets = max(8, math.ceil(sum(counted.values()) / bucket_rows))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    starts = F.broadcast(starts) if len(counted) * buckets <= broadcast_rows else starts
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = keyed.join(starts, ["length", "bucket"]).withColumn("number", F.col("before") + F.row_number().over(within) - 1)
    at = F.size(F.filter("begins", lambda b: b <= F.col("number")))
    placed = numbered.join(F.broadcast(table), "length").withColumn("at", at)
    picked = {name: F.element_at(source, F.col("at")) for name, source in (("begin", "begins"), ("each_", "each"), ("first", "firsts"), ("offset_", "offsets"))}
    inside = F.col("number") - F.col("begin")
    return placed.withColumns(picked).select(*pieces.columns, (F.col("first") + F.floor(inside / F.col("each_"))).cast("long").alias("sequence_id"), (F.col("offset_") + F.col("length") * (inside % F.col("each_"))).cast("long").alias("offset"))


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  path: a tokenizers file."""
    return pack_pieces(materialize(document_pieces(df, path, capacity, end_id, id_col, text_col), "pieces"), capacity)
