"""Language identification by prediction by partial matching.

For each language a context tree over bytes holds how often a byte followed each context of 0 to 3
bytes.  A byte seen in its longest context costs -log2 of its share there; else it costs the escape of
that context and is looked for in the next shorter one (escape method C, without exclusions), down
to a uniform byte.  The statistics are frozen after training; the language with the shortest code wins.

Texts are lower-cased, ASCII bytes that are no letters become spaces, and of a run of spaces the first
is coded, so symbols, digits and capitals say nothing about the language.

Trees are fitted on a bounded sample of labelled rows: at most ``train_rows`` whole texts for each
language, those with the smallest hashes of their ids, of ``train_bytes`` bytes each at most (longer and
very short texts are not drawn).  Every 4-byte string seen in any language gets a row with its exact
cost in each; workers look costs up for whole Arrow batches at once.

Defined results
    null text, or one without a letter: lang_pred "und", score 0
    no labelled rows at all: every row is "und", score 0
    ties of code length: the language first in alphabetical order
    repeated rows get equal results; an empty table an empty one; other columns are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, keep_rows, slices

ORDER = 3
#: ASCII letters to lower case, other ASCII to space, bytes of longer characters stay.
_FOLD = bytes((b | 32 if chr(b).isalpha() else 32) if b < 128 else b for b in range(256))


def fold(text: str) -> bytes:
    return text.lower().encode(errors="replace").translate(_FOLD)


#: Byte pairs up to which 4-byte strings are found in a square table (four bytes a cell: 64 MB at most).
DENSE_WIDTH = 4096


class Tree:
    """Counts of one language: for each order k the (k+1)-byte strings and their contexts."""

    def __init__(self, folded: bytes):
        raw = np.frombuffer(b"   " + folded, np.uint8).astype(np.uint32)
        keep = ~((raw[ORDER:] == 32) & (raw[ORDER - 1 : -1] == 32))
        key, self.levels = np.zeros(len(raw) - ORDER, np.uint32), []
        for k in range(ORDER + 1):
            key = key | (raw[ORDER - k : len(raw) - k] << np.uint32(8 * k))
            grams, times = np.unique(key[keep], return_counts=True)
            contexts, first, kinds = np.unique(grams >> np.uint32(8), return_index=True, return_counts=True)
            totals = np.add.reduceat(times, first) if len(times) else times
            self.levels.append((grams, times, contexts, totals, kinds))

    def cost(self, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each (k+1)-byte string, given the bytes before it."""
        if k < 0:
            return np.full(len(keys), 8.0)
        lower = self.cost(keys & np.uint32((1 << 8 * k) - 1), k - 1)
        escape, hit_cost, hit = self.parts(keys, k)
        return np.where(hit, hit_cost, escape + lower)

    def parts(self, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams, times, contexts, totals, kinds = self.levels[k]
        if not len(grams):
            zero = np.zeros(len(keys))
            return zero, zero, zero > 0
        context = keys >> np.uint32(8)
        c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        g = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
        seen, hit = contexts[c] == context, grams[g] == keys
        whole = (totals + kinds)[c]
        escape = np.where(seen, -np.log2(kinds[c] / whole), 0.0)
        return escape, -np.log2(np.where(hit, times[g], 1) / whole), hit


class Model:
    """Frozen statistics of all languages, laid out for lookups over whole batches."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        if not self.langs:
            return
        trees = [Tree(samples[name]) for name in self.langs]
        pairs = np.arange(1 << 16, dtype=np.uint32)
        self.cost1 = self._columns([t.cost(pairs, 1) for t in trees])
        known = np.unique(np.concatenate([(t.levels[3][0] >> np.uint32(s)) & np.uint32(0xFFFF) for t in trees for s in (0, 16)]))
        self.pair_id = np.zeros(1 << 16, np.int32)
        self.pair_id[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1

        def union(k: int) -> np.ndarray:
            return np.unique(np.concatenate([t.levels[k][0] for t in trees]))

        four, three = union(3), union(2)
        self.four, self.row4 = four, None
        if self.width <= DENSE_WIDTH:
            self.row4 = np.full(self.width * self.width, -1, np.int32)
            self.row4[self._key4(four >> np.uint32(16), four & np.uint32(0xFFFF))] = np.arange(len(four))
        self.cost4 = self._columns([t.cost(four, 3) for t in trees])
        self.grams3, self.cost3 = three, self._columns([t.cost(three, 2) for t in trees])
        self.contexts3 = np.unique(np.concatenate([t.levels[3][2] for t in trees]))
        self.escape3 = self._columns([t.parts(self.contexts3 << np.uint32(8), 3)[0] for t in trees])
        self.contexts2 = np.unique(np.concatenate([t.levels[2][2] for t in trees]))
        self.escape2 = self._columns([t.parts(self.contexts2 << np.uint32(8), 2)[0] for t in trees])

    @staticmethod
    def _columns(parts: list[np.ndarray]) -> np.ndarray:
        return np.ascontiguousarray(np.stack(parts, axis=1)).astype(np.float32)

    def _key4(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.pair_id[first] * self.width + self.pair_id[second]

    def _rows4(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The row of each 4-byte string, -1 for unknown ones: by a table of byte pairs, or by search where scripts are too many for one."""
        if self.row4 is not None:
            return self.row4[self._key4(first, second)]
        at, hit = self._find(self.four, ((first << np.uint32(16)) | second).astype(np.uint32))
        return np.where(hit, at, -1)

    @staticmethod
    def _find(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(rows, keys), len(rows) - 1)
        return at, rows[at] == keys

    def bits(self, folded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each text in each language, and how many bytes of it were coded."""
        raw = np.frombuffer(b"   " + b"   ".join(folded) + b"   ", np.uint8).astype(np.uint32)
        lengths = np.array([len(x) for x in folded], np.int64)
        starts = ORDER + np.concatenate([[0], np.cumsum(lengths + 3)[:-1]])
        pair = (raw[:-1] << np.uint32(8)) | raw[1:]
        first, second, last = pair[:-2], pair[2:], raw[ORDER:]
        rows = self._rows4(first, second)
        costs = self.cost4[rows]
        if len(miss := np.flatnonzero(rows < 0)):
            costs[miss] = self._shorter(((first[miss] << np.uint32(16)) | second[miss]).astype(np.uint32))
        coded = ~((last == 32) & (raw[ORDER - 1 : -1] == 32))
        costs[~coded] = 0
        ends = np.cumsum(costs, axis=0, dtype=np.float64)
        ends = np.concatenate([np.zeros((1, costs.shape[1])), ends])
        count = np.concatenate([[0], np.cumsum(coded)])
        a, b = starts - ORDER, starts - ORDER + lengths
        return ends[b] - ends[a], count[b] - count[a]

    def _shorter(self, keys: np.ndarray) -> np.ndarray:
        """Costs of 4-byte strings that no language has: escape to three bytes, and on."""
        three, at = keys & np.uint32(0xFFFFFF), self._find
        row, seen = at(self.contexts3, keys >> np.uint32(8))
        out = np.where(seen[:, None], self.escape3[row], 0)
        row, hit = at(self.grams3, three)
        context, known = at(self.contexts2, three >> np.uint32(8))
        lower = np.where(known[:, None], self.escape2[context], 0) + self.cost1[three & np.uint32(0xFFFF)]
        return out + np.where(hit[:, None], self.cost3[row], lower)


def held_out(id_col: str = "doc_id", fold_count: int = 4, fold_out: int = 2):
    """True for rows that training never sees: crc32 of the id as text, modulo fold_count."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")) % fold_count == fold_out


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 500, train_bytes: int = 20_000, least_bytes: int = 200) -> Model:
    """A model of the labelled rows of df that are not held out."""
    size = F.octet_length(col(text_col))
    rows = df.where(col(lang_col).isNotNull() & ~held_out(id_col) & col(text_col).isNotNull()).select(col(lang_col).cast("string").alias("lang"), F.xxhash64(col(id_col).cast("string"), F.lit("train")).alias("h"), col(text_col).alias("text"), size.alias("size"))
    short = F.col("size") <= train_bytes
    found = rows.groupBy("lang").agg(F.count(F.when(short, 1)), F.count(F.when(short & (F.col("size") >= least_bytes), 1))).collect()
    long_enough = {r[0]: (r[1], r[2]) for r in found}
    samples: dict[str, bytes] = {}
    if not long_enough:
        return Model(samples)
    shares, span = None, 1 << 30
    for name, (every, enough) in long_enough.items():
        if not every:
            # no text under the bound: the shortest there are, as many as fit into a sample, one at least
            by_size = rows.where(F.col("lang") == name).select("size", "h").orderBy("size", "h").limit(train_rows).collect()
            total, last = 0, by_size[0]
            for r in by_size:
                total += r["size"]
                if total > train_rows * train_bytes:
                    break
                last = r
            mine = (F.col("lang") == name) & (F.struct("size", "h") <= F.struct(F.lit(last["size"]).alias("size"), F.lit(last["h"]).alias("h")))
            shares = mine if shares is None else shares | mine
            continue
        floor, n = (least_bytes, enough) if enough else (0, every)
        bound = span if n <= train_rows else int(span * train_rows / n)
        mine = short & (F.col("lang") == name) & (F.col("size") >= floor) & (F.pmod(F.col("h"), F.lit(span)) < bound)
        shares = mine if shares is None else shares | mine
    drawn = sorted(((r[0], r[1], r[2]) for r in rows.where(shares).select("lang", "h", "text").toLocalIterator()))
    by_lang: dict[str, list[bytes]] = {}
    for name, _, text in drawn:
        if len(mine := by_lang.setdefault(name, [])) < train_rows:
            mine.append(fold(text))
    return Model({name: b"   ".join(texts) for name, texts in by_lang.items()})


def predict(model: Model, texts: list[str], evidence: int = 64) -> tuple[list[str], list[float], list[float | None]]:
    """Language, score and bits per coded byte of each text."""
    lang, score, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
    at = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if model.langs else []
    if at:
        bits, coded = model.bits([fold(texts[i]) for i in at])
        coded = np.maximum(coded, 1)
        excess = (bits - bits.min(axis=1, keepdims=True)) * (np.minimum(coded, evidence) / coded)[:, None]
        share = 1 / np.exp2(-excess).sum(axis=1)
        for i, k, s, b in zip(at, bits.argmin(axis=1).tolist(), share.tolist(), (bits.min(axis=1) / coded).tolist(), strict=True):
            lang[i], score[i], rate[i] = model.langs[k], s, b
    return lang, score, rate


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows of df whose language is told with at least this score; rows of "und" go."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return keep_rows(df, text_col, lambda texts: [s >= least_score for s in predict(shared.value, texts)[1]])


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", evidence: int = 64) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, bits_per_byte.

    score is the winner's share of 2^-(code length) with the code lengths scaled to ``evidence`` coded bytes
    at most, so that a long text does not make it 1 by length alone.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, 128):
            lang, score, rate = predict(model, [t or "" for t in batch.column(2).to_pylist()], evidence)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], schema=arrow)

    rows = df.select(col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")
