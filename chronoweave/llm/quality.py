"""Quality rules: divergence of a document's histograms from those of its language.

A document has two histograms: characters by class, and words by common word (all others in one
bin).  Both are compared, by Jensen-Shannon distance (root of the divergence in bits, 0 to 1), with the
references of the languages; a document is judged by the language that is nearest on the whole.
Documents below a minimum length are too noisy to judge that way and pass the comparison they are too
short for.  The references are sums over all documents that pass the base rules, by their lang.

Base rules, before that: fewer than 10 words, or over 20 % of the words in repeated 5-word windows, fail.

Defined results
    null text: no words, so base_failed
    a language with fewer than ``least_reference`` words has no reference of its own; without any
    reference no document is rejected by the comparison
    repeated rows get equal results (and count each time in the references); an empty table an empty one
    other columns are not read
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, keep_rows, slices

#: Frequent function words, by language.
COMMON_WORDS = {
    "de": "der die das und in zu den von mit ist im auf für ein eine dem des sich nicht als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie",
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son aux mais comme elle tout nous sa fait été",
}
WORDS = sorted({w for line in COMMON_WORDS.values() for w in line.split()})
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "beyond")
_SYMBOLS = "#*$%&|<>"


def _class_table() -> np.ndarray:
    """Byte -> class; continuation bytes of a longer character count as none (7)."""
    table = np.full(256, 5, np.int64)
    for b in range(128):
        c = chr(b)
        table[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\n\r\x0b\x0c" else 4 if c in ".,;:!?'\"()-" else 5
    table[0x80:0xC0] = 7
    table[0xC0:] = 6
    return table


_CLASS = _class_table()
_BIN = {w.encode(): i for i, w in enumerate(WORDS)}


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of so many words that occur at least twice in the text."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    if len(number) == n:
        return 0
    key, kinds = ids, len(number)
    for k in range(1, window):
        key = key[: n - k] * len(number) + ids[k:]
        kinds *= len(number)
        if kinds * len(number) >= 1 << 63 and k < window - 1:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            kinds = len(key)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    edges[at] += 1
    edges[at + window] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_rules(text: str) -> tuple[list[bytes], bytes, tuple[int, int, int, int, int], bool]:
    """The words, the bytes, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), base_failed."""
    raw = text.encode()
    words = raw.split()
    word_chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeat = repeated_words(words)
    counts = (len(words), word_chars, symbols, len(lines) - len(set(lines)), repeat)
    return words, raw, counts, len(words) < 10 or 100 * repeat > 20 * len(words)


def histograms(words: list[bytes], raw: bytes) -> np.ndarray:
    """Counts: character classes, then common words and all other words."""
    classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)[:7]
    out = np.zeros(7 + len(WORDS) + 1)
    out[:7] = classes
    common = Counter(raw.lower().split())
    for w in _BIN.keys() & common.keys():
        out[7 + _BIN[w]] = common[w]
    out[-1] = len(words) - out[7:-1].sum()
    return out


def distance(p: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of one histogram to each reference (rows), all normalised here."""
    p = p / max(p.sum(), 1)
    q = references / np.maximum(references.sum(axis=1, keepdims=True), 1)
    mid = (q + p) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / mid), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / mid), 0).sum(axis=1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


def references(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least_reference: int = 2000) -> dict[str, list[float]]:
    """Language -> summed histograms, over every document that has a lang and passes the base rules."""
    size = 7 + len(WORDS) + 1
    arrow = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, raw, _, failed = base_rules(text.as_py() or "")
                if not failed:
                    sums.setdefault(lang, np.zeros(size))
                    sums[lang] += histograms(words, raw)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array(range(size), pa.int32()), pa.array(total.astype(np.int64))], schema=arrow)

    rows = df.where(col(lang_col).isNotNull()).select(col(lang_col).cast("string").alias("lang"), col(text_col).alias("text"))
    sums = rows.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    out: dict[str, list[float]] = {}
    for lang, at, n in sums.collect():
        out.setdefault(lang, [0.0] * size)[at] = float(n)
    return {lang: h for lang, h in sorted(out.items()) if sum(h[7:]) >= least_reference}


class Judge:
    """Decides over one text at a time, by frozen references and limits."""

    def __init__(self, reference: dict[str, list[float]], char_limit: float = 0.31, word_limit: float = 0.32, least_chars: int = 60, least_words: int = 120):
        self.langs, self.table = list(reference), np.array(list(reference.values()), float).reshape(len(reference), 7 + len(WORDS) + 1)
        self.char_limit, self.word_limit, self.least_chars, self.least_words = char_limit, word_limit, least_chars, least_words

    def __call__(self, text: str) -> tuple:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance, nearest."""
        words, raw, counts, failed = base_rules(text)
        if failed or not self.langs:
            return (*counts, failed, not failed, None, None, None)
        own = histograms(words, raw)
        chars, common = distance(own[:7], self.table[:, :7]), distance(own[7:], self.table[:, 7:])
        k = int((chars + common).argmin())
        char, word = float(chars[k]), float(common[k])
        kept = (own[:7].sum() < self.least_chars or char <= self.char_limit) and (len(words) < self.least_words or word <= self.word_limit)
        return (*counts, failed, bool(kept), char, word, self.langs[k])


def keep_clean(df: DataFrame, reference: dict[str, list[float]], text_col: str = "text", **limits: float) -> DataFrame:
    """The rows of df, with all their columns, that the rules keep."""
    verdict = Judge(reference, **limits)
    return keep_rows(df, text_col, lambda texts: [verdict(t)[6] for t in texts], 512)


def judge(df: DataFrame, reference: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance, nearest."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    arrow = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in names], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64()), ("nearest", pa.string())])
    verdict = Judge(reference, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(doc, *verdict(text.as_py() or "")) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            columns = zip(*found, strict=True) if found else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    rows = df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, char_distance double, word_distance double, nearest string")
