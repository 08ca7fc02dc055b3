"""SimHash near-duplicates: byte-position index with count filtering, exact verification, components.

Two 64-bit fingerprints that differ in at most 4 bits share at least 4 of their 8 positional bytes, so at least
3 of the first 7.  The index lists every fingerprint under each of its 35 triples of positional bytes among the
first 7: a list of one byte value would hold 1/256 of all fingerprints, and pairs of it grow with the square of
the corpus.  For each pair that meets in a list the shared positional bytes are tallied over all 8 places; pairs
with fewer than 4 are dropped, the bits of the others are verified.  A pair is looked at under the first triple
that it shares only.

Lists up to SHORT are compared pair by pair, longer ones yield the links of a spanning forest, not all pairs.
A list beyond LONG is not held by one task: its rows are cut into blocks, and every two blocks go to a task of
their own, which spans their links; so any list is done exactly in bounded memory.

Equal fingerprints are one node from the start, so copies cost nothing after their first aggregation.

Cases: null and empty texts have fingerprint zero and are linked like any other; texts of fewer than four
words have one shingle; repeated ids and rows get equal results; null ids never name a component, unless it
has no other (then null); very long texts are hashed in blocks; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm.bpe import utf8_rows
from fluxgrid.llm.common import drop, id_text, map_arrow, store, stored

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Of 8 positional bytes at most 4 differing bits leave 4 equal, so 3 of the first 7, which make up a list's key.
SHARED, PLACES, KEY_BYTES = 8 - MAX_BITS, 7, 3
GROUPS = list(combinations(range(PLACES), KEY_BYTES))
#: Lists up to this length are compared pair by pair, longer ones by a forest.
SHORT = 32
#: Most rows of a list that one task holds, and rows of a block of a longer list.
LONG, LIST_BLOCK = 8192, 4096
#: Shingles whose bits are tallied at once.
BLOCK = 1 << 15


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    n = len(ends)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, BLOCK):
        part = [digest(joined[s:e], SEED) for s, e in zip(starts[a : a + BLOCK], ends[a : a + BLOCK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def text_digest(text: str) -> Column:
    """Digest of a text; a null one has the empty digest."""
    return F.coalesce(F.sha2(F.col(text), 256), F.lit(""))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, with ``digests`` the digest of the text, and fp (the fingerprint as a signed long) of every document."""
    names = ["doc_id", "digest"] if digests else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in utf8_rows(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fp)], [*names, "fp"])

    rows = id_text(docs, id_col, text_col)
    if digests:
        rows = rows.withColumn("digest", text_digest("text"))
    return map_arrow(rows, run, ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names) + ", fp long")


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows (list, fp): the number of the byte group and its bytes make up the list's key."""
    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        for a in range(0, len(fp), 2048):
            part = np.ascontiguousarray(fp[a : a + 2048])
            octets = part.view(np.uint8).reshape(-1, 8).astype(np.int64)
            keys = [(g << 24) | octets[:, p[0]] << 16 | octets[:, p[1]] << 8 | octets[:, p[2]] for g, p in enumerate(GROUPS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.tile(part, len(GROUPS)).view(np.int64))], ["list", "fp"]
            )


#: Number of a group by the set of its places, as bits.
NUMBERS = np.full(1 << PLACES, -1, np.int64)
for _g, _p in enumerate(GROUPS):
    NUMBERS[sum(1 << k for k in _p)] = _g


def first_group(shared: np.ndarray) -> np.ndarray:
    """Number of the first group among shared bytes; ``shared`` is (pairs, 8) of bool with 4 or more each."""
    place = np.argsort(~shared[:, :PLACES], axis=1, kind="stable")[:, :KEY_BYTES]
    return NUMBERS[(1 << place).sum(axis=1)]


def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the pairs that pass the count filter and the verification, their first shared group)."""
    x = a ^ b
    shared = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0
    kept = np.flatnonzero(shared.sum(axis=1) >= SHARED)
    kept = kept[np.bitwise_count(x[kept]) <= MAX_BITS]
    return kept, first_group(shared[kept])


def short_links(lists: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within short lists of sorted rows, each under its first shared group."""
    left, right = [], []
    for d in range(1, SHORT):
        same = np.flatnonzero(lists[d:] == lists[:-d])
        if not len(same):
            break
        kept, group = near(fps[same], fps[same + d])
        kept = kept[group == lists[same[kept]] >> 24]
        left.append(fps[same[kept]])
        right.append(fps[same[kept] + d])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one long list: a search that leaves out what it has reached."""
    left, right = [], []
    rest = np.unique(fps)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = np.bitwise_count(rest ^ at) <= MAX_BITS
            if hit.any():
                found = rest[hit]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found)
                rest = rest[~hit]
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


LINK_NAMES, LINK_KINDS = ["a", "b", "list", "block"], "a long, b long, list long, block long"


def link_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links as rows."""
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none], LINK_NAMES)


def list_links(lists: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of whole lists."""
    cuts = np.flatnonzero(np.diff(lists)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(lists)]
    size = ends - starts
    some = np.repeat((size > 1) & (size <= SHORT), size)
    long = [forest(fps[s:e]) for s, e in zip(starts[size > SHORT], ends[size > SHORT])]
    for a, b in [short_links(lists[some], fps[some]), *long]:
        if len(a):
            yield link_rows(a, b)


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows that are sorted by list; of lists beyond LONG the rows: (a, null, list, block)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # of the list that may go on
    size = 0  # its rows so far; they are passed on when they are too many

    def passed(lists: np.ndarray, fps: np.ndarray, start: int) -> pa.RecordBatch:
        block = (np.arange(len(fps)) + start) // LIST_BLOCK
        none = pa.nulls(len(fps), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), none, pa.array(lists), pa.array(block)], LINK_NAMES)

    key = None
    for b in batches:
        lists, fps = b.column("list").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
        if not len(lists):
            continue
        more = int(np.searchsorted(lists, key, "right")) if key is not None else 0
        if more:
            if size <= LONG < size + more:
                for k, f in held:
                    yield passed(k, f, size - sum(len(x) for _, x in held))
                    held = held[1:]
            if size + more > LONG:
                yield passed(lists[:more], fps[:more], size)
            else:
                held.append((lists[:more], fps[:more]))
            size += more
            lists, fps = lists[more:], fps[more:]
            if not len(lists):
                continue  # the list may go on
        cut = int(np.searchsorted(lists, lists[-1]))
        done = [*held, (lists[:cut], fps[:cut])]
        whole = [np.concatenate([x[k] for x in done]) for k in (0, 1)]
        if len(whole[0]):
            yield from list_links(*whole)
        key, size, held = lists[-1], len(lists) - cut, [(lists[cut:], fps[cut:])]
        if size > LONG:
            yield passed(*held.pop(), 0)
    if held:
        yield from list_links(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))


def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every two blocks (list: their key), whose rows are sorted by key."""
    held: list[np.ndarray] = []
    key = None
    for b in batches:
        keys, fps = b.column("list").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if keys[s] != key and held:
                yield link_rows(*forest(np.concatenate(held)))
                held = []
            key = keys[s]
            held.append(fps[s:e])
    if held:
        yield link_rows(*forest(np.concatenate(held)))


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column fp) with at most MAX_BITS differing bits."""
    index = map_arrow(nodes.select("fp"), listed, "list long, fp long")
    found = stored(map_arrow(index.repartition("list").sortWithinPartitions("list"), linked, LINK_KINDS), "links")
    rows = found.where("b IS NULL")
    # a row for each block of a long list, so no task joins a whole list
    blocks = rows.groupBy("list").agg(F.max("block").alias("last")).select(
        "list", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block")
    )
    dealt = rows.join(blocks, ["list", "block"]).select(
        "a", "list", "block", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other")
    )
    pairs = dealt.where("block <> other").select(
        F.xxhash64("list", F.least("block", "other"), F.greatest("block", "other")).alias("list"), F.col("a").alias("fp")
    )
    more = map_arrow(pairs.repartition("list").sortWithinPartitions("list"), spanned, LINK_KINDS)
    return found.where("b IS NOT NULL").select("a", "b").union(more.select("a", "b"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the least node of each component, for nodes that have links; rounds of two star steps.

    Every round is written to the shared folder in place of the last one; no edges reach the driver.  The joins
    by node are plain sort-merge joins, so a root with very many neighbours is split by the adaptive planner.
    """
    spark = edges.sparkSession
    path = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    kind = edges.schema["a"].dataType.simpleString()
    last = None
    while True:
        now = spark.read.schema(f"u {kind}, v {kind}").parquet(path)
        # large star: neighbours above a node move to the least node that it knows
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
        )
        before, path = path, store(
            small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), name
        )
        drop(spark, before)
        now = spark.read.schema(f"u {kind}, v {kind}").parquet(path)
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.crc32(F.concat_ws("/", "u", "v")))
        ).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state


def rooted(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints (column fp and others) with the root of their component."""
    found = components(links(nodes))
    # a node without links is its own component
    return nodes.join(
        found.union(found.select(F.col("root").alias("node"), "root").distinct()), F.col("fp") == F.col("node"), "left"
    ).select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every document: the least id that links reach."""
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = rooted(nodes)
    names = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    table = roots.join(names, "root").select("fp", "component_id")
    return prints.join(table, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each component: the one with the least id, null ids last, then the least digest.

    Of rows with that id and text the one whose other columns have the least hash stays.
    """
    prints = fingerprints(docs, id_col, text_col, digests=True)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest"))
    nodes = stored(prints.groupBy("fp").agg(least.alias("least")), "nodes")
    name = lambda i, digest: F.concat(F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("")), F.lit("|"), digest)
    keep = rooted(nodes).groupBy("root").agg(F.min("least").alias("least"))
    keep = keep.select(name(F.col("least.doc_id"), F.col("least.digest")).alias("__key"))
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c != text_col and "map<" not in kind]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        name(F.col(id_col), text_digest(text_col)).alias("__key"),
        F.xxhash64(*others).alias("__tie"),
    )
    # repeated rows meet before the shuffle, and the join keeps the partitions of the groups: texts move once
    one = rows.groupBy("__key").agg(F.min_by("__row", "__tie").alias("__row"))
    return one.join(keep, "__key", "left_semi").select("__row.*")
