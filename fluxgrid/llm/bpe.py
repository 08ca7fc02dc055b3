"""BPE encoding and decoding with the vocabulary of a public tokenizer file.

The merge loop keeps a priority queue of (rank, place) over a doubly linked symbol list and skips stale
entries; decoding concatenates vocabulary strings.  Words between ASCII white space never interact, so each
Python worker keeps a cache from word to packed ids, bounded by bytes; what the cache drops is computed again,
which changes speed only.

Cases: a null text counts as empty and gives no ids; very long texts are encoded whole; repeated rows give
equal results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fluxgrid.llm.common import id_text, map_arrow

#: Bytes of one generation of a worker's caches (two are kept), bytes that an entry takes besides key and
#: value, and the longest word that is kept.
WORD_BYTES, PIECE_BYTES, ENTRY_BYTES, LONGEST = 40 << 20, 4 << 20, 150, 64

PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
)


#: A stop or comma at the end of a word of letters and digits of ASCII and Latin-1; it is a piece of its own.
STOPS = re.compile(
    rb"[.,](?:(?<=[a-z0-9][.,])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][.,]))(?![^\x09-\x0d\x20])"
)


#: A capital before a letter from U+0300 up, perhaps a combining mark: the pair must be composed before it is
#: put in lower case, as some marks join the small letter only.
AS_IS = re.compile(rb"[A-Z][\xcc-\xff]")
#: Bytes that begin no letter from U+0300 up.
LOW_BYTES = bytes(range(0xCC))


def cache_words(text: bytes) -> list[bytes]:
    """Words between white space in lower case (ASCII), stops apart, so that few words differ.

    Pieces stay the same: without combining marks behind capitals lower case may come before composition, and
    such a stop never joins another piece.  A text with such marks, or that may hold special tokens, which are
    matched in their case, is only split; its words are composed and put in lower case one by one.
    """
    if b"<|" in text or (not text.isascii() and text.translate(None, LOW_BYTES) and AS_IS.search(text)):
        return text.split()
    return STOPS.sub(rb" \g<0>", text.lower()).split()


def byte_letters() -> list[str]:
    """Printable stand-in of each byte: printable Latin-1 stays, others move to 256 and up in order."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = (chr(256 + k) for k in range(256))
    return [chr(b) if b in keep else next(moved) for b in range(256)]


def lowered(text: str) -> str:
    """Character by character: no rule depends on a character's place in the word."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def normal_pieces(text: str) -> list[str]:
    """Pieces of a text without special tokens, normalised and in lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = lowered(text)
    if text.isalpha():  # most words are letters, perhaps with a stop behind
        return [text]
    if text[-1:] in {".", ","} and text[:-1].isalpha():
        return [text[:-1], text[-1]]
    return PIECES.findall(text)


class Vocabulary:
    """Vocabulary, merge table and special tokens of a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.specials.items()}
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + self.end] for c in letters]
        #: (left, right) -> (rank, merged)
        self.merges = {
            (ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])
        }
        self.special_split = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")"
        )

    def merged(self, piece: str) -> list[int]:
        """Ids of one piece."""
        data = piece.encode()
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        n, merges = len(symbols), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for k in range(n - 1):
            if found := merges.get((symbols[k], symbols[k + 1])):
                queue.append((found[0], k, symbols[k], symbols[k + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, k, left, right, joined = heapq.heappop(queue)
            nxt = after[k]
            if symbols[k] != left or nxt >= n or symbols[nxt] != right:
                continue  # stale: a neighbour was merged meanwhile
            symbols[k], symbols[nxt] = joined, -1
            after[k] = far = after[nxt]
            if far < n:
                before[far] = k
                if found := merges.get((joined, symbols[far])):
                    heapq.heappush(queue, (found[0], k, joined, symbols[far], found[1]))
            if (near := before[k]) >= 0 and (found := merges.get((symbols[near], joined))):
                heapq.heappush(queue, (found[0], near, symbols[near], joined, found[1]))
        return [s for s in symbols if s >= 0]


class Cache(dict):
    """key -> bytes, computed when missing; the generation before the present one is kept for its common keys.

    A generation ends when its keys and values reach ``most`` bytes; long keys are never kept.
    """

    def __init__(self, compute: Callable, most: int):
        super().__init__()
        self.compute, self.most, self.size, self.before = compute, most, 0, {}

    def __missing__(self, key):
        out = self.before.get(key)
        if out is None:
            out = self.compute(key)
            if len(key) > LONGEST:
                return out
        if self.size >= self.most:
            self.before = self.copy()
            self.clear()
            self.size = 0
        self.size += ENTRY_BYTES + len(key) + len(out)
        self[key] = out
        return out


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


class Coder:
    """Encoder and decoder of a worker."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.pieces = Cache(lambda piece: packed(v.merged(piece)), PIECE_BYTES)
        self.words = Cache(lambda word: self.word(word.decode()), WORD_BYTES)
        self.strings = [v.tokens.get(i, "").encode() for i in range(max(v.tokens) + 1)]

    def word(self, word: str) -> bytes:
        """Packed ids of a word: special tokens first, then pieces."""
        v = self.vocabulary
        if "<|" not in word:
            pieces = normal_pieces(word)
            if len(pieces) == 1:  # kept as a word already
                return packed(v.merged(pieces[0]))
            return b"".join(map(self.pieces.__getitem__, pieces))
        out = []
        for part in v.special_split.split(word):
            if part in v.specials:
                out.append(packed([v.specials[part]]))
            elif part:
                out += map(self.pieces.__getitem__, normal_pieces(part))
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole UTF-8 text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, cache_words(text)))

    def decode(self, ids: bytes) -> bytes:
        """Vocabulary strings of packed ids, joined by one space as the file names no decoder."""
        return b" ".join(map(self.strings.__getitem__, memoryview(ids).cast("I").tolist()))


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder for each file and worker."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def utf8_rows(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def list_array(rows: list[bytes]) -> pa.ListArray:
    """Packed 32-bit rows as one Arrow list column."""
    ends = np.cumsum([0] + [len(r) // 4 for r in rows], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids ARRAY<INT> of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [coder(path).encode(t) for t in utf8_rows(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), list_array(rows)], ["doc_id", "ids"])

    rows = id_text(docs, id_col, text_col)
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row of ids; a null list counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                coder(path).decode(np.asarray(x or [], "<u4").tobytes()).decode()
                for x in b.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    from pyspark.sql import functions as F

    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids on demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = coder(path)
            rows = [c.encode(t) for t in utf8_rows(b)]
            out = {
                "doc_id": b.column("doc_id"),
                "n_tokens": pa.array([len(r) // 4 for r in rows], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(c.decode(r)).hexdigest() for r in rows], pa.string()),
            }
            if with_ids:
                out["ids"] = list_array(rows)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    tail = ", ids array<int>" if with_ids else ""
    return map_arrow(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{tail}")
