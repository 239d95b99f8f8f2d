"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last eight bytes says so, so that equal passages of
different documents fall into equal chunks wherever they stand.  A worker encodes a chunk once and
keeps the ids under the chunk's bytes (not its hash, so there are no collisions), in a cache of fixed
size.  A cut may fall inside a word.  The joins are repaired: the bytes beside a cut, as far as the nearest
white space on each side, are encoded again, together with the next word of the chunk on either side.
These words must come out with the ids that they have in their chunks, and the join as it does alone; where they
do not, both chunks are added to the join, and the longer join is encoded again with the words beside it, until
both sides agree exactly, at the latest when the join is the whole text.  Where the tokenizer file is of another
make, whole texts go to the library.

Texts of printable ASCII and Latin letters are split by byte classes (or, where they hold an
apostrophe, by the file's own pattern) and merged by tiktoken's byte-pair merger, with the end-of-word
mark as byte 0 and the file's ids as ranks.  Anything else is encoded by the library, unit by unit.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import KEPT, col, slices

#: Printable bytes in the order in which byte-level vocabularies list them; the other bytes follow in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_MARK = "\0"
#: Between texts that are encoded in one call; plain texts have no such character.
_FENCE = "\x01"


def byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> byte."""
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 digit, 3 other, 4 fence; bytes of a longer character are letters (plain texts have no others)."""
    kinds = np.ones(256, np.uint8)
    for b in range(33, 127):
        kinds[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3
    kinds[list(b" \t\n\r\x0b\x0c")] = 0
    kinds[ord(_FENCE)] = 4
    return kinds


_KINDS = _classes()


def mark_words(text: str) -> str:
    """Pre-tokens of a plain lower-case text without apostrophes, each closed by the mark, white space dropped."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return ""
    kind = _KINDS[raw]
    ends = np.empty(len(kind), bool)
    ends[:-1] = kind[1:] != kind[:-1]
    ends[-1] = True
    ends |= kind == 2
    keep = kind != 0
    ends &= keep
    after = np.cumsum(keep.view(np.uint8) + ends.view(np.uint8), dtype=np.int64)
    out = np.zeros(int(after[-1]), np.uint8)
    out[(after - 1 - ends.view(np.uint8))[keep]] = raw[keep]
    return out.tobytes().decode()


class Remembered(dict):
    """bytes -> array, for about the last ``limit`` bytes: two generations, of which the older is dropped."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.held, self.old = limit // 2, 0, {}

    def find(self, key: bytes):
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: bytes, value: np.ndarray) -> None:
        if self.held > self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += len(key) + value.nbytes + 250
        self[key] = value


class Encoder:
    """Ids of a tokenizers file, as ``encode(text, add_special_tokens=False)`` gives them, for many texts a call."""

    def __init__(self, path: str, cache_bytes: int = 32 << 20):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        longest_first = sorted(self.by_special, key=len, reverse=True)
        self.special_cut = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")") if longest_first else None
        self.merger = self._merger(spec)
        self.pattern = regex.compile(_SPLIT)
        self.plain = re.compile("[ -~\t-\r\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*")
        self.units = Remembered(cache_bytes)

    def _merger(self, spec: dict):
        """tiktoken's merger over this vocabulary, or None if the file is not of the make that it can stand for."""
        model, norm, pre = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        want = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        steps = pre.get("pretokenizers") or [{}]
        like = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("ignore_merges") and norm.get("normalizers") == want
        like = like and steps[0].get("pattern") == {"Regex": _SPLIT} and len(steps) == 2 and steps[1].get("type") == "ByteLevel"
        if not like or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            return None
        made = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 512 + i for i, (a, b) in enumerate(made)):
            return None
        from tiktoken import Encoding

        letters, ranks = byte_letters(), {}
        for token, rank in model["vocab"].items():
            if token.encode() not in self.by_special:
                word, mark = (token[:-4], b"\0") if token.endswith("</w>") else (token, b"")
                ranks[bytes(letters[c] for c in word) + mark] = rank
        self.fence = ranks[_FENCE.encode() + b"\0"]
        return Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def _by_library(self, raw: bytes) -> np.ndarray:
        return np.array(self.library.encode(raw.decode(), add_special_tokens=False).ids, np.uint32)

    def _by_units(self, raw: bytes) -> np.ndarray:
        parts = []
        for unit in raw.split():
            ids = self.units.find(unit)
            if ids is None:
                self.units.put(unit, ids := self._by_library(unit))
            parts.append(ids)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def many(self, stretches: list[bytes]) -> list[np.ndarray]:
        """Ids of stretches that white space or a text's end bounds on both sides, special tokens apart."""
        if self.merger is None:
            return [self._by_library(raw) for raw in stretches]
        out: list = [None] * len(stretches)
        simple, quoted = [], []
        for i, raw in enumerate(stretches):
            text = raw.decode()
            if self.plain.fullmatch(text) is None:
                out[i] = self._by_units(raw)
            elif text.isascii() or unicodedata.is_normalized("NFC", text):
                (quoted if "'" in text else simple).append((i, text.lower()))
            else:
                quoted.append((i, unicodedata.normalize("NFC", text).lower()))
        for group, marks in ((simple, lambda texts: mark_words(f" {_FENCE} ".join(texts))), (quoted, lambda texts: f"{_FENCE}{_MARK}".join("".join([w + _MARK for w in self.pattern.findall(t)]) for t in texts))):
            if group:
                ids = np.frombuffer(array("I", self.merger(marks([t for _, t in group]))), np.uint32)
                at = np.flatnonzero(ids == self.fence)
                for (i, _), start, end in zip(group, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True):
                    out[i] = ids[start:end]
        return out

    def texts(self, texts: list[str], stretch_ids=None) -> list[np.ndarray]:
        """Ids of whole texts.  stretch_ids: what encodes stretches, ``many`` unless given."""
        if self.merger is None:
            return [self._by_library(t.encode()) for t in texts]
        parts, layout = [], []
        for text in texts:
            raw, mine = text.encode(), []
            pieces = self.special_cut.split(raw) if self.special_cut is not None and b"<|" in raw else [raw]
            for k, piece in enumerate(pieces):
                if k % 2:
                    mine.append(np.array([self.by_special[piece]], np.uint32))
                elif piece:
                    mine.append(len(parts))
                    parts.append(piece)
            layout.append(mine)
        ids = (stretch_ids or self.many)(parts)
        empty = np.empty(0, np.uint32)
        found = [[ids[x] if isinstance(x, int) else x for x in mine] for mine in layout]
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else empty for x in found]


_ENCODERS: dict[str, Encoder] = {}
KEPT.append(_ENCODERS)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def chunk_cuts(raw: bytes, mean: int) -> list[int]:
    """Ends of the content-defined chunks of a text: where the hash of the last eight bytes is below a bound, and the text's end."""
    n = len(raw)
    if n <= 8:
        return [n]
    base = np.frombuffer(raw, np.uint8)
    keys = np.zeros(n - 7, np.uint64)
    for k in range(8):
        keys |= base[k : n - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    keys *= np.uint64(0x9E3779B97F4A7C15)
    cuts = (np.flatnonzero(keys < np.uint64((1 << 64) // mean)) + 8).tolist()
    return cuts if cuts and cuts[-1] == n else [*cuts, n]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _last_word(chunk: bytes) -> bytes:
    """The last word with the white space around it; empty if there is none."""
    parts = chunk.rsplit(None, 1)
    return chunk[len(parts[0]) :] if len(parts) == 2 else chunk if parts else b""


def _first_word(chunk: bytes) -> bytes:
    parts = chunk.split(None, 1)
    return chunk[: len(chunk) - len(parts[1])] if len(parts) == 2 else chunk if parts else b""


class ChunkEncoder:
    """Encodes stretches chunk by chunk; equal chunks are encoded once for as long as they are remembered.

    Counts the chunks: encoded, reused (met before in this call, or remembered), and the bytes of each; joins, and how many of them grew.
    """

    def __init__(self, path: str, mean: int, cache_bytes: int = 128 << 20):
        self.base, self.mean = encoder(path), mean
        self.chunks = Remembered(cache_bytes)
        self.encoded = self.reused = self.encoded_bytes = self.reused_bytes = self.joins = self.grown = 0

    def cut(self, raw: bytes) -> list[tuple[bool, bytes]]:
        """A text as (True, inner part of a chunk) and, between two of them and at the ends, (False, join)."""
        out, tail, start = [], b"", 0
        for end in chunk_cuts(raw, self.mean):
            chunk = raw[start:end]
            start = end
            first = _SPACE.search(chunk)
            if first is None:  # no white space: all of it belongs to the join
                tail += chunk
                continue
            head, inner = chunk[: first.start()], chunk[first.start() :]
            words = len(inner) - len(inner.rsplit(None, 1)[-1]) if inner[-1:] not in b" \t\n\r\x0b\x0c" else len(inner)
            if inner[:words].isspace():  # no word that could agree
                tail += chunk
                continue
            out += [(False, tail + head), (True, inner[:words])]
            tail = inner[words:]
        return [*out, (False, tail)]

    def many(self, stretches: list[bytes]) -> list[np.ndarray]:
        layout = [self.cut(raw) for raw in stretches]
        chunks: dict[bytes, np.ndarray | None] = {}
        for parts in layout:
            for inner, raw in parts:
                if inner:
                    if raw in chunks or chunks.setdefault(raw, self.chunks.find(raw)) is not None:
                        self.reused, self.reused_bytes = self.reused + 1, self.reused_bytes + len(raw)
        new = [c for c, ids in chunks.items() if ids is None]
        self.encoded, self.encoded_bytes = self.encoded + len(new), self.encoded_bytes + sum(map(len, new))
        for raw, ids in zip(new, self.base.many(new), strict=True):
            chunks[raw] = ids
            self.chunks.put(raw, ids.copy())
        return self.repaired(layout, chunks)

    def repaired(self, layout: list[list[tuple[bool, bytes]]], chunks: dict[bytes, np.ndarray]) -> list[np.ndarray]:
        """The ids of each text.  Joins grow by the chunks beside them until these agree with what the join makes of their words."""
        made: dict[bytes, np.ndarray] = {b"": np.empty(0, np.uint32)}
        layout, open_texts = list(layout), range(len(layout))
        while open_texts:
            windows = {}
            for k in open_texts:
                parts = layout[k]
                for i in range(0, len(parts), 2):
                    windows[k, i] = _last_word(parts[i - 1][1]) if i else b"", parts[i][1], _first_word(parts[i + 1][1]) if i + 1 < len(parts) else b""
            new = list({x for window in windows.values() for x in (*window, b"".join(window))} - made.keys())
            made.update(zip(new, self.base.many(new), strict=True))
            failed: dict[int, set[int]] = {}
            for (k, i), window in windows.items():
                before, join, after = (made[x] for x in window)
                agree = np.array_equal(made[b"".join(window)], np.concatenate([before, join, after]))
                if agree and i and len(before):
                    agree = np.array_equal(chunks[layout[k][i - 1][1]][-len(before) :], before)
                if agree and i + 1 < len(layout[k]) and len(after):
                    agree = np.array_equal(chunks[layout[k][i + 1][1]][: len(after)], after)
                if not agree:
                    failed.setdefault(k, set()).add(i)
            for k, at in failed.items():
                layout[k] = self._grown(layout[k], at)
                self.grown += len(at)
            open_texts = [k for k in failed if len(layout[k]) > 1]
            whole = [layout[k][0][1] for k in failed if len(layout[k]) == 1]
            made.update(zip(whole, self.base.many(whole), strict=True))
        self.joins += sum(len(parts) // 2 + 1 for parts in layout)
        return [np.concatenate([chunks[raw] if inner else made[raw] for inner, raw in parts]) for parts in layout]

    @staticmethod
    def _grown(parts: list[tuple[bool, bytes]], at: set[int]) -> list[tuple[bool, bytes]]:
        """The same text with the joins at these places taking in the chunks beside them, and the joins behind those."""
        out = [parts[0]]
        for i in range(1, len(parts), 2):
            if i - 1 in at or i + 1 in at:
                out[-1] = (False, out[-1][1] + parts[i][1] + parts[i + 1][1])
            else:
                out += [parts[i], parts[i + 1]]
        return out

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        return self.base.texts(texts, self.many)


_CHUNKED: dict[tuple[str, int], ChunkEncoder] = {}
KEPT.append(_CHUNKED)


def chunk_encoder(path: str, mean: int) -> ChunkEncoder:
    if (path, mean) not in _CHUNKED:
        _CHUNKED[path, mean] = ChunkEncoder(path, mean)
    return _CHUNKED[path, mean]


class Strings:
    """Ids -> decimal text and decoded text.  A file without a decoder joins its tokens' strings by one space; any other is decoded by the library."""

    def __init__(self, path: str):
        self.library = encoder(path).library
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.joins = self.library.decoder is None
        self.decimal = [str(i) for i in range(size)]
        self.token = [self.library.id_to_token(i) for i in range(size)]

    def decimals(self, ids: list[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))

    def decoded(self, ids: list[int]) -> str:
        return " ".join(map(self.token.__getitem__, ids)) if self.joins else self.library.decode(ids, skip_special_tokens=False)


_STRINGS: dict[str, Strings] = {}
KEPT.append(_STRINGS)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1024, digests_only: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, and ids array<int> and decoded string, or with digests_only the SHA-256 of each.

    Null text is the empty text: no ids, empty decoded text.  Repeated rows give repeated results, an
    empty table an empty one.  Only the id and the text are read; other columns never matter.  Every row is
    worked on alone in a map over Arrow batches: no shuffle, no key that could be hot, and a lost
    executor only repeats its tasks.
    """
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string")
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())] + ([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests_only else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(path, chunk_bytes)
        if path not in _STRINGS:
            _STRINGS[path] = Strings(path)
        strings = _STRINGS[path]
        for batch in slices(batches, 128):
            counts, first, second = [], [], []
            for found in encode.texts([t or "" for t in batch.column(1).to_pylist()]):
                ids = found.tolist()
                counts.append(len(ids))
                if digests_only:
                    first.append(hashlib.sha256(strings.decimals(ids).encode()).hexdigest())
                    second.append(hashlib.sha256(strings.decoded(ids).encode()).hexdigest())
                else:
                    first.append(found.astype(np.int32))
                    second.append(strings.decoded(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, arrow.field(2).type), pa.array(second, pa.string())], schema=arrow)

    return df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, schema)


def document_pieces(df: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row and piece of at most ``capacity`` ids (the document's ids, then end_id): doc_id, piece, start, length, ids_crc32."""
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end, step = array("I", [end_id]).tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches, 64):
            docs, pieces, starts, lengths, sums = [], [], [], [], []
            found = encode.texts([t or "" for t in batch.column(1).to_pylist()])
            for doc, mine in zip(batch.column(0).to_pylist(), found, strict=True):
                ids = mine.astype("<u4").tobytes() + end
                for i, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    docs.append(doc)
                    pieces.append(i)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((docs, pieces, starts, lengths, sums), arrow, strict=True)], schema=arrow)

    return df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
