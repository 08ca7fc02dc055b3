"""Substring dedup by repeated-phrase automata.

A window is WINDOW consecutive words of a document; a word goes when a window over it also starts in a
document with a smaller id.  Steps, each over all documents:

1. Equal word sequences are grouped; only the one with the smallest id (the first) goes on.  In its copies
   every word of a document of WINDOW words or more is covered.
2. Each window has an anchor, the least hash of its GRAM-word phrases, so equal windows have equal anchors.
   Anchors of several documents are kept, each with its smallest document as the root of its family.
3. Runs of windows with kept anchors become spans of text, one family each.  Window hashes of a family that
   occur in two documents confirm a recurring passage; it is kept for the smallest document that has it.
4. Passages are cut into GRAM-word phrases, of which every window holds one whole, and each family's phrases
   are compiled into Aho-Corasick automata; the family's spans are streamed through them.  Every hit is
   extended word by word against its passage, so what is removed is exact, whatever hashes do.

Automata are sharded by family, and the spans of a large family are dealt over several tasks, each with the
same automata.  A family with many phrases gets several automata, one after the other.  The spans are all of a
document that can hold a confirmed passage; the rest of it, which shares no anchor with another document, is
known to hold none and is not streamed.

Cases: null and empty texts have no words; null ids are never smaller and lose nothing; texts of fewer than
WINDOW words lose nothing; rows with equal ids count as one document and lose nothing to each other; ids may be
of any type that has an order; very long texts are read whole; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm.bpe import utf8_rows
from fluxgrid.llm.common import id_text, map_arrow, stored

WINDOW, GRAM = 50, 20
#: Phrases start at every STEP-th word of a passage and at its last place, so each window holds a whole one.
STEP = WINDOW - GRAM + 1
#: Words that a worker's cache of hashes holds, phrases in one automaton, bytes and number of spans for one task.
MAX_WORDS, MAX_PHRASES, TASK_BYTES, TASK_SPANS = 200_000, 50_000, 4 << 20, 128
#: Parts into which the rows of one family are dealt before they meet its size, and bytes of remembered spans.
PARTS, MEMO_BYTES = 64, 4 << 20

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class WordHashes(dict):
    """UTF-8 word -> 64-bit hash; emptied when full, long words are not kept."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) > 64:
            return out
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = out
        return out


_hashes = WordHashes()
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """First n powers of BASE and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, b in enumerate((BASE, INVERSE)):
            steps = np.full(size, b)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return [p[:n] for p in _powers]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hash of every word."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Mixed hash of every ``width`` consecutive words."""
    up, down = powers(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
    x = (sums[width:] - sums[:-width]) * down[: len(h) - width + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def anchors(h: np.ndarray) -> np.ndarray:
    """Anchor of every window: the least of its phrase hashes."""
    x, width, want = rolling(h, GRAM), 1, WINDOW - GRAM + 1
    while 2 * width <= want:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    if width < want:
        x = np.minimum(x[: len(x) - (want - width)], x[want - width :])
    return x


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of every run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def longs(x: np.ndarray) -> list[int]:
    """Unsigned hashes as signed longs."""
    return x.view(np.int64).tolist()


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, key (SHA-256 of the words joined by one space), marks (distinct anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, marks = [], [], []
            for t in utf8_rows(b):
                words = t.split()
                n.append(len(words))
                keys.append(hashlib.sha256(b" ".join(words)).digest())
                marks.append(longs(np.unique(anchors(word_hashes(words)))) if len(words) >= WINDOW else [])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.list_(pa.int64()))],
                ["doc_id", "n_words", "key", "marks"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, n_words long, key binary, marks array<long>")


def candidates(firsts: DataFrame) -> DataFrame:
    """doc_id, key, kept (anchor, root): anchors that several first documents have."""
    rows = firsts.select("doc_id", "key", F.explode("marks").alias("mark"))
    shared = rows.groupBy("mark").agg(F.min("doc_id").alias("root"), F.max("doc_id").alias("most"))
    shared = shared.where(F.col("root") < F.col("most")).select("mark", "root")
    return rows.join(shared, "mark").groupBy("doc_id", "key").agg(F.collect_list(F.struct("mark", "root")).alias("kept"))


def id_kind(rows: DataFrame, column: str = "doc_id") -> str:
    """Type of the ids in a schema string."""
    return rows.schema[column].dataType.simpleString()


def batch_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows as a batch."""
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))


def spans(rows: DataFrame) -> DataFrame:
    """root, doc_id, key, start (word), words (joined): runs of windows whose anchors have one root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            kept = b.column("kept").to_pylist()
            ids, keys = b.column("doc_id").to_pylist(), b.column("key").to_pylist()
            for doc, key, own, t in zip(ids, keys, kept, utf8_rows(b)):
                words = t.split()
                if hashlib.sha256(b" ".join(words)).digest() != key:
                    continue  # another text with the same id
                marks = anchors(word_hashes(words)).view(np.int64)
                known = np.array([x["mark"] for x in own], np.int64)
                order = np.argsort(known)
                known = known[order]
                numbers: dict = {}  # of roots
                roots = np.array([numbers.setdefault(own[k]["root"], len(numbers)) for k in order.tolist()], np.int64)
                names = list(numbers)
                at = np.minimum(np.searchsorted(known, marks), len(known) - 1)
                hit = known[at] == marks
                root = np.where(hit, roots[at], -1)
                # a run ends where its root changes
                for a, z in runs(hit):
                    cuts = [a, *(np.flatnonzero(np.diff(root[a:z])) + a + 1).tolist(), z]
                    for s, e in zip(cuts, cuts[1:]):
                        out.append((names[root[s]], doc, key, s, b" ".join(words[s : e + WINDOW - 1]).decode()))
            one = b.schema.field("doc_id").type
            yield batch_of(out, {"root": one, "doc_id": one, "key": pa.binary(), "start": pa.int64(), "words": pa.string()})

    kind = id_kind(rows)
    return map_arrow(rows, run, f"root {kind}, doc_id {kind}, key binary, start long, words string")


def windows(rows: DataFrame) -> DataFrame:
    """root, doc_id, hash of every window of the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(rolling(word_hashes(t.split()), WINDOW)).view(np.int64) for t in utf8_rows(b, "words")]
            at = pa.array(np.repeat(np.arange(len(found)), np.array([len(x) for x in found], np.int64)))
            hashes = np.concatenate([np.zeros(0, np.int64), *found])
            yield pa.RecordBatch.from_arrays(
                [b.column("root").take(at), b.column("doc_id").take(at), pa.array(hashes)], ["root", "doc_id", "hash"]
            )

    kind = id_kind(rows)
    return map_arrow(rows.select("root", "doc_id", "words"), run, f"root {kind}, doc_id {kind}, hash long")


def confirmed(rows: DataFrame) -> DataFrame:
    """root, doc_id, hashes: windows of several documents, listed with the smallest of these."""
    return (
        windows(rows)
        .groupBy("root", "hash")
        .agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most"))
        .where(F.col("doc_id") < F.col("most"))
        .groupBy("root", "doc_id")
        .agg(F.collect_list("hash").alias("hashes"))
    )


def passages(rows: DataFrame) -> DataFrame:
    """root, doc_id, words of every recurring passage, from spans joined to confirmed hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            root, doc = b.column("root").to_pylist(), b.column("doc_id").to_pylist()
            hashes = b.column("hashes")
            for k, t in enumerate(utf8_rows(b, "words")):
                words = t.split()
                found = np.isin(rolling(word_hashes(words), WINDOW).view(np.int64), hashes[k].values.to_numpy())
                out += [(root[k], doc[k], b" ".join(words[s : e + WINDOW - 1]).decode()) for s, e in runs(found)]
            one = b.schema.field("doc_id").type
            yield batch_of(out, {"root": one, "doc_id": one, "words": pa.string()})

    kind = id_kind(rows)
    return map_arrow(
        rows.select("root", "doc_id", "words", "hashes"), run, f"root {kind}, doc_id {kind}, words string"
    )


class Family:
    """Automata over the phrases of one family's passages.

    What covers a span depends on its words and on how many passages are of smaller documents, so spans of equal
    words, of which a common passage has very many, are looked at once.
    """

    def __init__(self):
        self.passages: list[tuple[object, list[str]]] = []
        self.phrases: dict[str, list[tuple[int, int]]] = {}
        self.automata: list | None = None
        self.firsts: list | None = None
        self.memo: dict[tuple[int, str], list[tuple[int, int]]] = {}
        self.memo_size = 0

    def add(self, doc, text: str) -> None:
        """A passage of a document."""
        words = text.split(" ")
        n = len(self.passages)
        self.passages.append((doc, words))
        for s in {*range(0, len(words) - GRAM + 1, STEP), len(words) - GRAM}:
            self.phrases.setdefault(f" {' '.join(words[s : s + GRAM])} ", []).append((n, s))

    def compiled(self) -> list:
        """Automata of at most MAX_PHRASES phrases each."""
        if self.automata is None:
            import ahocorasick

            self.automata = []
            keys = list(self.phrases)
            for a in range(0, len(keys), MAX_PHRASES):
                machine = ahocorasick.Automaton()
                for phrase in keys[a : a + MAX_PHRASES]:
                    machine.add_word(phrase, phrase)
                machine.make_automaton()
                self.automata.append(machine)
        return self.automata

    def covered(self, doc, text: str) -> list[tuple[int, int]]:
        """[start, end) words of a span that windows of passages of smaller documents cover."""
        if self.firsts is None:
            self.firsts = sorted({d for d, _ in self.passages})
        key = bisect_left(self.firsts, doc), text
        if key not in self.memo:
            if self.memo_size > MEMO_BYTES:
                self.memo.clear()
                self.memo_size = 0
            self.memo[key] = self.located(doc, text)
            self.memo_size += len(text) + 200
        return self.memo[key]

    def located(self, doc, text: str) -> list[tuple[int, int]]:
        """The same by the automata."""
        words = text.split(" ")
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        n = len(words)
        gone = np.zeros(n - WINDOW + 1, bool)  # windows
        seen: set[tuple[int, int]] = set()
        line = f" {text} "
        for machine in self.compiled():
            for end, phrase in machine.iter(line):
                at = bisect_left(starts, end - len(phrase) + 1)
                low, high = max(0, at + GRAM - WINDOW), min(n - WINDOW, at) + 1
                if gone[low:high].all():
                    continue
                for k, s in self.phrases[phrase]:
                    first, passage = self.passages[k]
                    if first >= doc or (k, at - s) in seen:
                        continue
                    # extend the hit along its diagonal
                    a, z = at, at + GRAM
                    while a > 0 and a - at + s > 0 and words[a - 1] == passage[a - at + s - 1]:
                        a -= 1
                    while z < n and z - at + s < len(passage) and words[z] == passage[z - at + s]:
                        z += 1
                    if a <= 0 and z >= n or a - at + s <= 0 and z - at + s >= len(passage):
                        seen.add((k, at - s))  # nothing else on this diagonal
                    if z - a >= WINDOW:
                        gone[a : z - WINDOW + 1] = True
                        if gone[low:high].all():
                            break  # no other passage adds to what holds this phrase
        return merged([(a, z + WINDOW - 1) for a, z in runs(gone)])


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint intervals in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by family, passages (kind 0) before spans: covered words (doc_id, key, first, last + 1)."""
    now, family = None, None
    for b in batches:
        out = []
        cols = [b.column(c).to_pylist() for c in ("root", "salt", "kind", "doc_id", "key", "start", "words", "passages")]
        for root, salt, kind, doc, key, start, words, given in zip(*cols):
            if (root, salt) != now:
                now, family = (root, salt), Family()
            if kind == 0:
                for passage in given:
                    family.add(passage["doc_id"], passage["words"])
            elif family.passages:
                out += [(doc, key, start + a, start + z) for a, z in family.covered(doc, words)]
        yield batch_of(
            out, {"doc_id": b.schema.field("doc_id").type, "key": pa.binary(), "first": pa.int64(), "end": pa.int64()}
        )


def located(found: DataFrame, span: DataFrame) -> DataFrame:
    """Covered words of all spans, by each family's automata; large families are dealt over several tasks.

    The size of a family is known in each of PARTS parts, so the rows of no family meet it in one task.
    """
    sized = span.groupBy("root").agg(
        F.greatest(F.sum(F.length("words")) / TASK_BYTES, F.count("*") / TASK_SPANS).alias("tasks")
    )
    sized = sized.where("tasks > 1").select(
        "root",
        F.ceil("tasks").cast("int").alias("salts"),
        F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"),
    )
    salts = F.coalesce("salts", F.lit(1))
    part = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(PARTS)).cast("int")
    docs = span.withColumn("part", part("start", "doc_id")).join(sized, ["root", "part"], "left").select(
        "root", F.pmod(F.xxhash64("doc_id", "start"), salts).cast("int").alias("salt"),
        F.lit(1).alias("kind"), "doc_id", "key", "start", "words",
    )
    # the passages of a part of a family go as one row to each of its tasks
    packed = found.groupBy("root", part("words").alias("part")).agg(F.collect_list(F.struct("doc_id", "words")).alias("passages"))
    none = F.lit(None)
    phrases = packed.join(sized, ["root", "part"], "left").select(
        "root", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), none.cast(id_kind(span)).alias("doc_id"),
        none.cast("binary").alias("key"), F.lit(0).cast("long").alias("start"), none.cast("string").alias("words"), "passages",
    )
    docs = docs.withColumn("passages", none.cast(packed.schema["passages"].dataType))
    # automata take far more time for a byte than a shuffle does: tasks are not to be merged by their bytes
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = phrases.unionByName(docs).repartition(n, "root", "salt").sortWithinPartitions("root", "salt", "kind")
    return map_arrow(rows, streamed, f"doc_id {id_kind(rows)}, key binary, first long, end long")


def trimmed(rows: DataFrame) -> DataFrame:
    """doc_id, key, n_removed, kept (text) of documents that lose words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("doc_id", "key", "parts")]
            for doc, key, parts, t in zip(*cols, utf8_rows(b)):
                words = t.split()
                if hashlib.sha256(b" ".join(words)).digest() != key:
                    continue
                keep = np.ones(len(words), bool)
                for p in parts:
                    keep[p["first"] : p["end"]] = False
                left = b" ".join(w for w, k in zip(words, keep.tolist()) if k)
                out.append((doc, key, int((~keep).sum()), left.decode()))
            one = b.schema.field("doc_id").type
            yield batch_of(out, {"doc_id": one, "key": pa.binary(), "n_removed": pa.int64(), "kept": pa.string()})

    return map_arrow(rows, run, f"doc_id {id_kind(rows)}, key binary, n_removed long, kept string")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, after all recurring windows are taken out."""
    rows = id_text(docs, id_col, text_col)
    every = stored(measured(rows), "measured")
    firsts = stored(
        every.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
        .groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.min_by("marks", "doc_id").alias("marks")),
        "firsts",
    )
    own = candidates(firsts)
    texts = stored(rows.join(own, "doc_id"), "candidates")
    span = stored(spans(texts), "spans")
    found = stored(passages(span.join(confirmed(span), ["root", "doc_id"])), "passages")
    parts = located(found, span).groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "end")).alias("parts"))
    cut = trimmed(texts.select("doc_id", "key", "text").join(parts, ["doc_id", "key"]))
    cut = cut.select(
        F.col("doc_id").alias("cut_id"), F.col("key").alias("cut_key"), "n_removed", F.sha2("kept", 256).alias("cut_sha")
    ).distinct()
    labelled = every.select("doc_id", "n_words", "key").join(
        firsts.select(F.col("key").alias("first_key"), F.col("doc_id").alias("first_id")),
        F.col("key") == F.col("first_key"),
        "left",
    )
    joined = labelled.join(cut, (F.col("doc_id") == F.col("cut_id")) & (F.col("key") == F.col("cut_key")), "left")
    copy = F.col("doc_id") > F.col("first_id")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256))
        .otherwise(F.coalesce("cut_sha", F.lower(F.hex("key"))))
        .alias("kept_sha256"),
    )
