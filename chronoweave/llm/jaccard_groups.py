"""N-gram Jaccard join by a token-group matrix: similar documents in groups, one union of tokens a group.

A document is its set of distinct 5-word shingles (64-bit hashes).  Two documents link when their sets'
Jaccard index reaches the threshold; wanted are the classes that links make.

1. Equal sets (128-bit digest) are one set with one representative.
2. Tokens have one global order: rare ones by hash, then "hot" ones, those in the prefixes of over
   ``wide`` sets.  A set's prefix is its first n - ceil(t*n) + 1 tokens; sets that link share a token
   of their prefixes.  The order decides how much work there is, never the result.
3. Sets are put into groups: at first each alone.  While a token lies in the unions of over ``wide`` groups, each of
   these offers its sets one hub to join; a set whose overlap with its best hub is proven joins that
   hub's group.  So a thousand near copies become one group in a few rounds, with a row for each copy.
4. The token-group matrix has one row for each token and group: the union of the prefixes of the group's sets,
   with the sizes of the sets that hold the token.  The sets of the smaller of two groups are queries against the
   union of the larger: the tokens shared with the union, and where the first of them lies, bound the overlap that a query
   can have with any set of the group.  Where that bound reaches the threshold, the union of the group's whole sets
   bounds it again.  What is left first asks the sets that most of its shared tokens nominate (each token and group
   names one set); only if none of these links is the group opened: its sets meet its queries in blocks of 64 sets and
   256 queries, and only links leave a block.  (The union of a group of one set is that set, and the bound is that of the
   pair, with the places of the tokens that it shares.)
5. Whole sets are compared where the bound of a pair qualifies.  Each pair of groups compares its most promising
   pair first; the others only if that does not link them.  Inside a group nothing needs comparing, its sets are
   linked already.  A set that many others ask for is sent to several tasks, each with a part of those that ask.

Nothing is dropped at any width: tokens that stay wide after the rounds are compared in full.

Defined results
    null text or text without words: empty set, linked with nothing
    fewer than five words: the whole sequence is the one shingle
    repeated rows and equal texts are in one class; different texts under one id, and texts without an id, are documents of their
    own; a class is named by its smallest id, by null if none of its rows has one
    an empty table gives an empty table; only id and text are read
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_rows, col, let_go, materialize, slices

WINDOW = 5
#: A side of at most so many bytes (estimated as twice its rows and columns of 8 bytes) is broadcast; beyond, joins are left to shuffles.
BROADCAST_BYTES = 8 << 20
#: Sets that ask for one set in one task.
ASKING = 128
#: Sets of a group that a query asks before the group is opened.
NOMINEES = 2
#: Queries and members of an opened group that are compared in one task.
BLOCK = (256, 64)
#: Rows in an Arrow batch, at most.
ARROW_ROWS = 2000
#: Hot tokens are an array in each worker: at most so many, for more the width is raised.
HOT_LIMIT = 1_000_000


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles."""
    words = (text or "").encode(errors="replace").lower().split()
    if not words:
        return np.empty(0, np.int64)
    word = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = max(1, len(word) - WINDOW + 1)
    mixed = np.full(n, min(len(word), WINDOW), np.uint64)
    for k in range(min(WINDOW, len(word))):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
        mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sets(df: DataFrame, percent: int) -> DataFrame:
    """Per row: doc_id, n, digest, low (the tokens of the smallest hashes: the prefix and a tenth of the set more)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("low", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches):
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            lows = [s[: prefix_length(len(s), percent) + len(s) // 10 + 16] for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lows])]).astype(np.int32)
            low = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lows) if lows else np.empty(0, np.int64)))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(digests, pa.binary()), low], schema=arrow)

    return df.mapInArrow(run, "doc_id long, n int, digest binary, low array<long>")


def _ordered(df: DataFrame, hot, percent: int, whole: bool) -> DataFrame:
    """rep, n, tokens (the prefix under the global order; null if the stored tokens do not reach), late, last (its last token, and whether that is hot).

    df: rep, n, low or (whole) doc_id, text.
    """
    arrow = pa.schema([("rep", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64())), ("late", pa.bool_()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_tokens = hot.value
        for batch in slices(batches):
            sizes, out, late, last = [], [], [], []
            for i in range(batch.num_rows):
                tokens = shingles(batch.column(1)[i].as_py()) if whole else batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                n = len(tokens) if whole else batch.column(1)[i].as_py()
                wanted = prefix_length(n, percent)
                is_hot = _among(tokens, hot_tokens)
                rare = int((~is_hot).sum())
                if len(tokens) < n and rare < wanted:
                    prefix = None
                else:
                    prefix = np.concatenate([tokens[~is_hot], tokens[is_hot]])[:wanted]
                sizes.append(n)
                out.append(prefix)
                late.append(None if prefix is None else rare < wanted)
                last.append(None if prefix is None or not len(prefix) else int(prefix[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.int64())), pa.array(late, pa.bool_()), pa.array(last, pa.int64())], schema=arrow)

    return df.mapInArrow(run, "rep long, n int, tokens array<long>, late boolean, last long")


def _among(tokens: np.ndarray, hot_tokens: np.ndarray) -> np.ndarray:
    if not len(hot_tokens) or not len(tokens):
        return np.zeros(len(tokens), bool)
    return hot_tokens[np.minimum(np.searchsorted(hot_tokens, tokens), len(hot_tokens) - 1)] == tokens


def _touched(df: DataFrame, hot, percent: int) -> DataFrame:
    """token: the stored tokens of those sets (rep, n, low) whose prefix by hash has a hot token."""
    arrow = pa.schema([("token", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for n, low in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = low.values.to_numpy(zero_copy_only=False)
                if _among(tokens[: prefix_length(n, percent)], hot.value).any():
                    yield pa.RecordBatch.from_arrays([pa.array(tokens)], schema=arrow)

    return df.mapInArrow(run, "token long")


def _whole_tokens(df: DataFrame, *keys: str) -> DataFrame:
    """keys (long), token: all tokens of the documents (keys, text)."""
    arrow = pa.schema([*[pa.field(k, pa.int64()) for k in keys], ("token", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i, text in enumerate(batch.column(len(keys))):
                tokens = shingles(text.as_py())
                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(tokens), batch.column(c)[i].as_py(), np.int64)) for c in range(len(keys))], pa.array(tokens)], schema=arrow)

    return df.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} long" for k in (*keys, "token")))


def _hot(scratch: Scratch, tokens: DataFrame, wide: int, known: np.ndarray) -> np.ndarray:
    """The known hot tokens and those that come over ``wide`` times; for too many of them the width is raised."""
    widths = scratch.table(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("width")).where(F.col("width") > wide), "hot", narrow=True)
    while widths.where(F.col("width") > wide).count() > HOT_LIMIT - len(known):
        wide *= 2
        if wide > 1 << 60:
            return known
    found = np.array([r[0] for r in widths.where(F.col("width") > wide).select("token").toLocalIterator()], np.int64)
    return np.union1d(known, found)


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if 16 * rows * len(df.columns) <= BROADCAST_BYTES else df


def connected(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): equal labels for connected nodes.  Edges shrink by each node's smallest neighbour until none is left."""
    write = partial(scratch.table, narrow=True) if scratch else materialize
    left = write(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("next")), "hooks")
        first, second = step.select(F.col("node").alias("a"), F.col("next").alias("x")), step.select(F.col("node").alias("b"), F.col("next").alias("y"))
        left = write(left.join(first, "a").join(second, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if labels is None:
            labels = step.select("node", F.col("next").alias("label"))
        else:
            moved = step.select(F.col("node").alias("label"), "next")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        labels = write(labels, "labels")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, label long")
    return labels


def verified(pairs: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets reach the threshold.  pairs: a table; documents: doc_id, text.

    The pairs go to the documents; a document's set is sent once for each pair that it asks in, and once if it is asked.
    """

    def tokens(rows: DataFrame, key: str, out: str, more: list[str]) -> DataFrame:
        fields = [pa.field(c, pa.int64()) for c in (key, *more)]
        arrow = pa.schema([*fields, (out, pa.list_(pa.int64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 128):
                sets = pa.array([shingles(t.as_py()) for t in batch.column(len(fields))], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(fields))], sets], schema=arrow)

        return rows.select(key, *more, "text").mapInArrow(run, ", ".join(f"{f.name} long" for f in fields) + f", {out} array<long>")

    rows = pairs.count()
    crowds = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("asking")).where(F.col("asking") > ASKING)
    dealt = pairs.join(_few(crowds, rows // ASKING), "b", "left").select("a", "b", F.ceil(F.coalesce("asking", F.lit(1)) / ASKING).alias("tasks"))
    asking = documents.join(_few(dealt.select(F.col("a").alias("doc_id"), "b", F.pmod(F.xxhash64("a"), "tasks").alias("task")), rows), "doc_id").withColumnRenamed("doc_id", "a")
    asked = documents.join(_few(dealt.select(F.col("b").alias("doc_id"), "tasks").distinct(), rows), "doc_id").withColumnRenamed("doc_id", "b")
    sent = tokens(asked, "b", "tb", ["tasks"]).select("b", "tb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"))
    both = tokens(asking, "a", "ta", ["b", "task"]).join(sent, ["b", "task"])
    compared = both.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("common"), (F.size("ta") + F.size("tb")).alias("total"))
    return compared.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b").distinct()


def _beyond(n, percent: int):
    """How many tokens of a set of n lie beyond its prefix."""
    return F.ceil(F.lit(percent) * n / 100).cast("int") - 1


def _reach(percent: int):
    """Whether two sets (columns _a and _b) that share ``common`` tokens of their prefixes can still reach the threshold.

    Of the set whose prefix ends first, all shared prefix tokens are counted, so only tokens beyond its prefix can add to
    them; and beyond the places of the last shared token both sets have only so many.
    """
    a_ends_first = (F.col("late_a") < F.col("late_b")) | ((F.col("late_a") == F.col("late_b")) & (F.col("last_a") <= F.col("last_b")))
    rest = F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1, F.when(a_ends_first, _beyond(F.col("n_a"), percent)).otherwise(_beyond(F.col("n_b"), percent)))
    return (100 + percent) * (F.col("common") + rest) >= percent * (F.col("n_a") + F.col("n_b"))


def _reach_group(percent: int):
    """Whether a query (_a) that shares ``common`` tokens with a group's union can reach the threshold with any set of the group (sizes low to high).

    The overlap with a set is at most what is shared of the prefixes and what lies beyond the one that ends first; nothing lies
    before the first shared token.  The smallest set that may link asks for the smallest overlap.
    """
    most = F.least(F.col("common") + F.greatest(_beyond(F.col("n_a"), percent), _beyond(F.col("high"), percent)), F.col("n_a") - F.col("first_at"))
    smallest = F.greatest(F.col("low"), F.ceil(F.lit(percent) * F.col("n_a") / 100).cast("int"))
    return (100 * F.col("high") >= percent * F.col("n_a")) & (percent * F.col("low") <= 100 * F.col("n_a")) & ((100 + percent) * most >= percent * (F.col("n_a") + smallest))


def _by_whole_union(opened: DataFrame, groups: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs of query and group (rep_a, grp_b, n_a, low) whose whole set can reach the threshold with the union of the group's whole sets."""
    asking = opened.select(F.col("rep_a").alias("doc_id")).distinct()
    asked = groups.join(opened.select(F.col("grp_b").alias("grp")).distinct(), "grp", "left_semi").select(F.col("rep").alias("doc_id"), F.col("grp").alias("grp_b"))
    own = _whole_tokens(documents.join(_few(asking, asking.count()), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep_a"), "rep_a").distinct()
    union = _whole_tokens(documents.join(_few(asked, asked.count()), "doc_id"), "grp_b").distinct()
    shared = own.join(opened, "rep_a").join(union, ["grp_b", "token"]).groupBy("rep_a", "grp_b", "n_a", "low").agg(F.count(F.lit(1)).alias("shared"))
    smallest = F.greatest(F.col("low"), F.ceil(F.lit(percent) * F.col("n_a") / 100).cast("int"))
    return shared.where((100 + percent) * F.col("shared") >= percent * (F.col("n_a") + smallest)).select("rep_a", "grp_b")


def _sent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys (long), tokens: the sets of the documents (keys, text), one row each."""
    arrow = pa.schema([*[pa.field(k, pa.int64()) for k in keys], ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = pa.array([shingles(t.as_py()) for t in batch.column(len(keys))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], sets], schema=arrow)

    return rows.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", tokens array<long>")


def _inside(opened: DataFrame, groups: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links of the pairs of query and group (rep_a, grp_b), found in blocks of so many queries and members; only links leave a block."""
    asked = groups.join(opened.select(F.col("grp_b").alias("grp")).distinct(), "grp", "left_semi").select(F.col("rep").alias("doc_id"), F.col("grp").alias("grp_b"))
    shape = asked.groupBy("grp_b").agg(F.ceil(F.count(F.lit(1)) / BLOCK[1]).alias("blocks")).join(opened.groupBy("grp_b").agg(F.ceil(F.count(F.lit(1)) / BLOCK[0]).alias("parts")), "grp_b")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    members = asked.join(shape, "grp_b").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks")).select("doc_id", "grp_b", "block", "parts")
    held = _sent(documents.join(_few(members, asked.count()), "doc_id").withColumnRenamed("doc_id", "rep"), ["rep", "grp_b", "block", "parts"]).select("rep", "grp_b", "block", "tokens", every("parts").alias("part"))
    asking = opened.select(F.col("rep_a").alias("doc_id")).distinct()
    sets = _sent(documents.join(_few(asking, asking.count()), "doc_id", "left_semi"), ["doc_id"]).withColumnRenamed("doc_id", "rep_a")
    places = opened.join(shape, "grp_b").withColumn("part", F.pmod(F.xxhash64("rep_a"), "parts")).select("rep_a", "grp_b", "part", every("blocks").alias("block"))

    def compare(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(members) and len(queries):
            sizes = np.array([len(t) for t in members["tokens"]])
            tokens, starts, ids = np.concatenate(members["tokens"].to_list()), np.cumsum(sizes) - sizes, members["rep"].to_numpy()
            for a, own in zip(queries["rep_a"], queries["tokens"], strict=True):
                common = np.add.reduceat(_among(tokens, np.asarray(own)).astype(np.int64), starts)
                out += [(a, b) for b in ids[100 * common >= percent * (sizes + len(own) - common)]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    keys = ["grp_b", "block", "part"]
    return held.groupBy(*keys).cogroup(places.join(sets, "rep_a").groupBy(*keys)).applyInPandas(compare, "a long, b long").distinct()


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, wide: int = 64, rounds: int = 4) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id of its class)."""
    spark = df.sparkSession
    # Rows of a batch are whole texts: fewer of them keep what Arrow holds outside of the heap small.
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    batch_rows(spark, ARROW_ROWS)
    try:
        return _classes(df, id_col, text_col, percent, wide, rounds)  # all jobs with texts run in here
    finally:
        spark.conf.set(key, before)


def _classes(df: DataFrame, id_col: str, text_col: str, percent: int, wide: int, rounds: int) -> DataFrame:
    spark = df.sparkSession
    scratch = Scratch(spark)
    documents = df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    documents, keys = _keyed(documents, scratch)
    stored = scratch.table(_sets(documents, percent), "sets")
    sets = scratch.table(stored.select("doc_id", "n", "digest"), "digests")
    repeats = _repeats(sets)
    equal = scratch.table(sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "equal-sets")
    kept = stored.where("n > 0").join(_few(equal.select(F.col("rep").alias("doc_id")), equal.count()), "doc_id", "left_semi")
    kept = (kept.dropDuplicates(["doc_id"]) if repeats else kept).select(F.col("doc_id").alias("rep"), "n", "low")

    # Hot tokens: wide in the prefixes by hash; then wide among the other tokens of sets that have such; then among the
    # whole sets of those whose stored tokens are mostly hot.
    wanted = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1
    hot = spark.sparkContext.broadcast(_hot(scratch, kept.select(F.explode(F.slice("low", F.lit(1), wanted)).alias("token")), wide, np.empty(0, np.int64)))
    hot = spark.sparkContext.broadcast(_hot(scratch, _touched(kept, hot, percent), wide, hot.value))
    scratch.drop()

    def deep_documents(reps: DataFrame) -> DataFrame:
        found = documents.join(_few(reps, reps.count()), "doc_id", "left_semi")
        return found.dropDuplicates(["doc_id"]) if repeats else found

    deep = scratch.table(_ordered(kept, hot, percent, whole=False).where("tokens is null").select(F.col("rep").alias("doc_id")), "deep")
    if not deep.isEmpty():
        hot = spark.sparkContext.broadcast(_hot(scratch, _whole_tokens(deep_documents(deep)), wide, hot.value))
    shallow = scratch.table(_ordered(kept, hot, percent, whole=False), "prefixes")
    scratch.drop(stored)
    deep = scratch.table(shallow.where("tokens is null").select(F.col("rep").alias("doc_id")), "deep")
    prefixes = shallow.where("tokens is not null").union(_ordered(deep_documents(deep), hot, percent, whole=True))
    rows = prefixes.select("rep", "n", "late", "last", F.posexplode("tokens").alias("at", "token"))
    shared = scratch.table(rows.groupBy("token").agg(F.count(F.lit(1)).alias("width")).where("width > 1"), "shared")
    matrix = scratch.table(rows.join(shared.select("token").hint("shuffle_merge"), "token").select("token", "rep", "n", "at", "late", "last"), "matrix")
    scratch.drop(shallow)

    groups = None  # (rep, grp) of the sets that are no longer alone
    links, joined = [], []

    def grouped() -> DataFrame:
        if groups is None:
            return matrix.withColumn("grp", F.col("rep"))
        return matrix.join(groups, "rep", "left").withColumn("grp", F.coalesce("grp", "rep"))

    def join_groups(found: DataFrame):
        links.append(scratch.table(found, "links", narrow=True))
        every = links[0]
        for more in links[1:]:
            every = every.union(more)
        joined.append(connected(every, scratch))
        return joined[-1].select(F.col("node").alias("rep"), F.col("label").alias("grp"))

    tried = None
    for _ in range(rounds):
        now = scratch.table(grouped(), "grouped")
        crowded = scratch.table(now.groupBy("token", "grp").agg(F.lit(1).alias("x")).groupBy("token").agg(F.count(F.lit(1)).alias("width")).where(F.col("width") > wide).select("token"), "crowded", narrow=True)
        few = crowded.count()
        if not few:
            break
        offered = scratch.table(now.join(_few(crowded, few), "token"), "offered")
        weight = offered.groupBy("rep").agg(F.count(F.lit(1)).alias("weight"))
        best = offered.join(weight, "rep").groupBy("token").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"), "n", "grp")).alias("hub"))
        hubs = best.select("token", (-F.col("hub.rep")).alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.grp").alias("hub_grp"))
        meets = (F.col("grp") != F.col("hub_grp")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
        counted = offered.join(_few(hubs, few), "token").where(meets).groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("common"))
        if tried is not None:
            counted = counted.join(tried, ["rep", "hub"], "left_anti")
        chosen = counted.groupBy("rep").agg(F.max(F.struct("common", (-F.col("hub")).alias("hub"))).alias("best")).select(F.col("rep").alias("a"), (-F.col("best.hub")).alias("b"))
        chosen = scratch.table(chosen, "tried", narrow=True)
        asked = chosen.select(F.col("a").alias("rep"), F.col("b").alias("hub"))
        tried = asked if tried is None else tried.union(asked)
        if chosen.isEmpty():
            break
        found = scratch.table(verified(chosen, documents, percent), "found", narrow=True)
        scratch.drop()
        if not found.isEmpty():
            groups = join_groups(found)

    sets_of = scratch.table(grouped(), "grouped")
    size, many = None, 0
    sized = sets_of.withColumn("members", F.lit(1).cast("long"))
    if groups is not None:
        size = scratch.table(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("members")), "sizes", narrow=True)
        many = size.count()
        sized = sets_of.join(_few(size, many), "grp", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    columns = ("rep", "n", "at", "late", "last", "grp", "members")
    queries = sized.select("token", *[F.col(c).alias(f"{c}_a") for c in columns])
    # The matrix: a group of one set is a row as it stands, and exact; larger ones are united.
    one, held = F.col("members") == 1, ("rep", "n", "at", "late", "last")
    union = sized.where(one).select("token", F.col("grp").alias("grp_b"), F.col("members").alias("members_b"), F.col("n").alias("low"), F.col("n").alias("high"), *[F.col(c).alias(f"{c}_b") for c in held])
    if many:
        united = sized.where(~one).groupBy("token", F.col("grp").alias("grp_b")).agg(F.max("members").alias("members_b"), F.min("n").alias("low"), F.max("n").alias("high"), *[F.min(c).alias(f"{c}_b") for c in held])
        union = union.unionByName(united)
    smaller = (F.col("members_a") < F.col("members_b")) | ((F.col("members_a") == F.col("members_b")) & (F.col("grp_a") < F.col("grp_b")))
    near = (F.col("grp_a") != F.col("grp_b")) & smaller & (100 * F.col("n_a") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("n_a"))
    alone = F.col("members_b") == 1
    ends = ["rep_a", "grp_a", "n_a", "late_a", "last_a", "grp_b", "members_b"]
    exact = [F.max(F.when(alone, F.col(c))).alias(c) for c in ("rep_b", "n_b", "late_b", "last_b")]
    met = queries.join(union, "token").where(near).groupBy(*ends).agg(F.count(F.lit(1)).alias("common"), F.max("at_a").alias("at_a"), F.min("at_a").alias("first_at"), F.max("at_b").alias("at_b"), F.min("low").alias("low"), F.max("high").alias("high"), *exact)
    met = scratch.table(met.where(F.when(alone, _reach(percent)).otherwise(_reach_group(percent))), "met")
    pairs = met.where(alone).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "grp_a", "grp_b", "common")
    opened = met.where(~alone).select("rep_a", "grp_b", "n_a", "low")
    if many and not opened.isEmpty():
        opened = scratch.table(_by_whole_union(opened, groups, documents, percent), "opened", narrow=True)
        for number in range(NOMINEES):
            nominee = F.min_by("rep", F.struct(F.xxhash64("rep", F.lit(number)), "rep")).alias("b")
            named = sized.where(~one).groupBy("token", F.col("grp").alias("grp_b")).agg(nominee)
            asking = queries.join(_few(opened.select("rep_a", "grp_b"), opened.count()), "rep_a").select("token", "grp_b", F.col("rep_a").alias("a"))
            votes = asking.join(named, ["token", "grp_b"]).groupBy("a", "grp_b", "b").agg(F.count(F.lit(1)).alias("votes"))
            asked = votes.groupBy("a", "grp_b").agg(F.max(F.struct("votes", "b")).alias("best")).select("a", "grp_b", "best.b")
            asked = scratch.table(asked, "asked", narrow=True)
            found = scratch.table(verified(asked.select("a", "b").distinct(), documents, percent), "found", narrow=True)
            links.append(found)
            done = asked.join(found, ["a", "b"], "left_semi").select(F.col("a").alias("rep_a"), "grp_b")
            opened = scratch.table(opened.join(done, ["rep_a", "grp_b"], "left_anti"), "opened", narrow=True)
        links.append(scratch.table(_inside(opened.select("rep_a", "grp_b"), groups, documents, percent), "inside", narrow=True))
    likely = scratch.table(pairs, "likely")
    scratch.drop()
    first = scratch.table(likely.groupBy("grp_a", "grp_b").agg(F.max(F.struct("common", "a", "b")).alias("best")).select("best.a", "best.b"), "first", narrow=True)
    groups = join_groups(verified(first, documents, percent))
    scratch.drop()
    sides = groups.select(F.col("rep").alias("a"), F.col("grp").alias("x")), groups.select(F.col("rep").alias("b"), F.col("grp").alias("y"))
    rest = scratch.table(likely.join(first, ["a", "b"], "left_anti").join(sides[0], "a", "left").join(sides[1], "b", "left").where("x is null or y is null or x <> y").select("a", "b"), "rest", narrow=True)
    if not rest.isEmpty():
        groups = join_groups(verified(rest, documents, percent))

    scratch.drop_all_but(sets, equal, joined[-1], keys)
    smallest = groups.join(groups.groupBy("grp").agg(F.min("rep").alias("component_id")), "grp").select("rep", "component_id")
    classes = equal.join(smallest, "rep", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    member = sets.select("doc_id", "n", "digest").join(classes, "digest", "left")
    found = member.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    if keys is None:
        return found
    own, heads = keys.select(F.col("key").alias("doc_id"), F.col("id").alias("own")), keys.select(F.col("key").alias("component_id"), F.col("id").alias("head"))
    return found.join(own, "doc_id").join(heads, "component_id").select(F.col("own").alias("doc_id"), "n_shingles", F.col("head").alias("component_id"))


def _keyed(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """documents with ids that each stand for one text, and (key, id, sha) of these ids where they are not the table's own.

    Own ids do unless some are null or repeat; then each pair of id and text gets a key, in the order of ids, null last, so that a
    class's smallest key is that of its smallest id.
    """
    if documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return documents, None
    hashed = documents.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    order = hashed.select(F.col("doc_id").alias("id"), "sha").distinct().orderBy(F.col("id").asc_nulls_last(), "sha")
    keys = scratch.table(order.withColumn("key", F.monotonically_increasing_id()), "keys")
    named = keys.select("key", "id", F.col("sha").alias("of"))
    return scratch.table(hashed.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of"))).select(F.col("key").alias("doc_id"), "text"), "keyed"), keys


def _repeats(sets: DataFrame) -> bool:
    """Whether ids repeat (then representatives are told apart by one row each)."""
    return not sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
