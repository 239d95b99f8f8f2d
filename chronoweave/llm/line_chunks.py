"""Line dedup by content-defined line chunks.

Lines are hashed; a chunk ends after a line where a hash of this line and the one before it says so.  The
ends depend on the lines around them alone, so a passage of lines that stands in several documents
is cut at the same places in each, whatever stands before it.  Chunks of at least two lines with
words are counted over all documents by a 128-bit hash.  For those that repeat, the bytes are compared by
grouping on hash and bytes together (map tasks send each distinct chunk once, however often they met
it); a hash under which two different chunks hide removes nothing.  The first place of a chunk, by
document id and place in the document, stays; all others are removed.

Chunks alone miss short passages and the rims of long ones.  drop_repeated_runs therefore also takes each line
with words together with the next one (and the blank lines between them) as a chunk of its own.  A run of
two or more such lines stands in an earlier place only if all its pairs do, so with their removal the
repeat is gone up to its first and last line with words; no line's last copy goes.

Defined results
    null text: no lines, empty text; a text that loses all its lines is empty too
    ties: repeated rows of one id and text are the same document, what is first in one is first in the other;
    different texts under one id are documents of their own, in the order of a hash; null ids come last
    a copy that overlaps its own first place (three equal lines) loses only what lies behind that place
    blank lines count as lines but make no chunk of "two lines"
    an empty table gives an empty table; only id and text are read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize, slices

#: Hashes of repeated chunks that fit into a broadcast; beyond, the join is left to shuffles.
SMALL_ROWS = 1_000_000


def chunk_spans(lines: list[bytes], mean: int) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk."""
    if not lines:
        return []
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64)
    pair = h * np.uint64(0x9E3779B97F4A7C15)
    pair[1:] ^= h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    pair ^= pair >> np.uint64(31)
    ends = (np.flatnonzero(pair % np.uint64(mean) == 0) + 1).tolist()
    if not ends or ends[-1] != len(lines):
        ends.append(len(lines))
    return list(zip([0, *ends[:-1]], ends, strict=True))


def eligible(lines: list[bytes]) -> bool:
    """Two lines with words, or more."""
    found = 0
    for line in lines:
        found += bool(line) and not line.isspace()
        if found == 2:
            return True
    return False


def pair_spans(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each line with words and the next such line."""
    worded = [i for i, line in enumerate(lines) if line and not line.isspace()]
    return [(a, b + 1) for a, b in zip(worded, worded[1:], strict=False)]


def units(lines: list[bytes], mean: int, pairs: bool) -> list[tuple[int, int]]:
    """The spans that are compared: eligible chunks, and the pairs that are no such chunk."""
    spans = [(a, b) for a, b in chunk_spans(lines, mean) if b - a > 1 and eligible(lines[a:b])]
    return sorted({*spans, *pair_spans(lines)}) if pairs else spans


def _units(documents: DataFrame, mean: int, pairs: bool, with_bytes: bool) -> DataFrame:
    arrow = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("h", pa.binary())])
    if with_bytes:
        arrow = pa.schema([("h", pa.binary()), ("chunk", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            out: list[list] = [[] for _ in arrow]
            for doc, text, version in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                lines = (text.as_py() or "").encode().split(b"\n")
                for a, b in units(lines, mean, pairs):
                    chunk = b"\n".join(lines[a:b])
                    h = xxhash.xxh3_128_digest(chunk)
                    for column, value in zip(out, (h, chunk) if with_bytes else (doc, version, a, b, h), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return documents.mapInArrow(run, "h binary, chunk binary" if with_bytes else "doc_id long, version long, a int, b int, h binary")


def drop_repeated_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = 4) -> DataFrame:
    """One row per input row: doc_id, text (without repeated chunks), n_lines, n_removed (lines), n_chunks_removed."""
    return _drop(df, id_col, text_col, mean, pairs=False)


def drop_repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = 4) -> DataFrame:
    """drop_repeated_chunks, and each line of every other repeated run of two or more lines with words; n_chunks_removed counts whole chunks."""
    return _drop(df, id_col, text_col, mean, pairs=True)


def _drop(df: DataFrame, id_col: str, text_col: str, mean: int, pairs: bool) -> DataFrame:
    documents = df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    places = materialize(_units(documents, mean, pairs, with_bytes=False), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "version", "a")
    counted = places.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    repeated = materialize(counted.select("h", "first"), "repeated")
    few = repeated.count()
    wanted = F.broadcast(repeated.select("h")) if few <= SMALL_ROWS else repeated.select("h")
    by_bytes = _units(documents, mean, pairs, with_bytes=True).join(wanted, "h", "left_semi").groupBy("h", "chunk").agg(F.lit(1).alias("x"))
    proven = by_bytes.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds = 1").select("h")
    known = repeated.join(proven, "h")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    behind = F.when(own, F.greatest("a", F.col("first.a") + F.col("b") - F.col("a"))).otherwise(F.col("a")).alias("from")
    others = places.join(F.broadcast(known) if few <= SMALL_ROWS else known, "h").where(~own | (F.col("a") != F.col("first.a")))
    removed = materialize(others.groupBy("doc_id", "version").agg(F.collect_set(F.struct("a", behind, "b")).alias("removed")), "removed")
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_chunks_removed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in arrow]
            for doc, text, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text, lost, whole = text.as_py(), set(), 0
                lines = [] if text is None else text.encode().split(b"\n")
                n = len(lines)
                if gone:
                    spans = set(chunk_spans(lines, mean))
                    whole = sum((x["a"], x["b"]) in spans for x in gone)
                    for x in gone:
                        lost.update(range(x["from"], x["b"]))
                    lines = [x for i, x in enumerate(lines) if i not in lost]
                for column, value in zip(out, (doc, b"\n".join(lines).decode(), n, len(lost), whole), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    found = removed.withColumnsRenamed({"doc_id": "removed_id", "version": "removed_version"})
    joined = documents.join(found, F.col("doc_id").eqNullSafe(F.col("removed_id")) & (F.col("version") == F.col("removed_version")), "left").select("doc_id", "text", "removed")
    return joined.mapInArrow(run, "doc_id long, text string, n_lines long, n_removed long, n_chunks_removed long")
