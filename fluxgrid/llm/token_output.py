"""Token ids as Parquet list columns: dictionary or delta encoding, bounded row groups, page indexes.

Documents are range-partitioned and sorted by id, so file after file the rows ascend; each row holds the id
of the document, its number of ids and the ids with an end id.  Reading two columns touches no token pages,
and page indexes let a range of documents be read alone.

Cases: a null text counts as empty and gives the end id only; null ids sort first; rows of one id, or without
one, keep the order of the input and may be dealt over several files; very long texts are kept whole; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.llm.bpe import PIECE_BYTES, Cache, byte_letters, cache_words, list_array, normal_pieces, packed, utf8_rows
from fluxgrid.llm.common import id_text, map_arrow, store

END_ID = 1
#: Writer options: row groups of 32 MB, pages of 256 KB, dictionaries as far as 1 MB, else delta encoding.
FORMAT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0",
}

#: Bytes of one generation of a worker's cache of words; this operator keeps nothing else, so it is large.
WORD_BYTES = 72 << 20

_encoders: dict[str, Cache] = {}


def library_words(path: str) -> Cache:
    """Word -> packed ids by the tokenizers library; one cache for each file and worker."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        ids = lambda text: packed(tokenizer.encode(text, add_special_tokens=False).ids)
        model, letters = tokenizer.model, byte_letters()

        def piece_ids(piece: str) -> bytes:
            return packed([t.id for t in model.tokenize("".join([letters[b] for b in piece.encode()]))])

        pieces = Cache(piece_ids, PIECE_BYTES)

        def word(data: bytes) -> bytes:
            text = data.decode()
            # the library normalises letters of Latin-1 alike and splits such a word at the same places
            if data.isascii() or (text.isalpha() and max(text) <= "\u00ff"):
                if "<|" not in text:
                    parts = normal_pieces(text)
                    return piece_ids(parts[0]) if len(parts) == 1 else b"".join(map(pieces.__getitem__, parts))
            return ids(text)

        _encoders[path] = Cache(word, WORD_BYTES)
    return _encoders[path]


def encoded(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids of sorted rows; the order of the rows stays."""
    tail = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = library_words(path)
            rows = [b"".join(map(known.__getitem__, cache_words(t))) + tail for t in utf8_rows(b)]
            n = pa.array([len(r) // 4 for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, list_array(rows)], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, n_tokens long, ids array<int>")


def write(
    docs: DataFrame, path: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Write the token files in the shared folder; their folder."""
    # the place in the input splits the rows of one id, so an id that many rows have is no single task
    rows = id_text(docs, id_col, text_col).withColumn("place", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    return store(encoded(ordered, path, end_id), "tokens", "zstd", **FORMAT)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of the token files, all read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            ends = ids.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy().astype("<i4", copy=False))).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
            keep = [b.column(c) for c in ("file", "row", "doc_id")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                ["file", "row", "doc_id", "n_tokens", "ids_crc32"],
            )

    files = spark.read.parquet(folder)
    number = F.regexp_extract("name", r"^part-([0-9]+)", 1).cast("long")
    kind = files.schema["doc_id"].dataType.simpleString()
    rows = files.select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "ids"
    )
    rows = map_arrow(rows, run, f"file string, row long, doc_id {kind}, n_tokens long, ids_crc32 long")
    # part files are numbered in the order of their ranges; one row for each file here
    sizes = files.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy(number, "name").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("name", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(
        Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(starts, F.col("file") == F.col("name"))
        .select("doc_id", (F.col("base") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )


def token_ids(spark: SparkSession, folder: str, low: int, high: int) -> DataFrame:
    """Rows of one range of documents; filters reach row groups and page indexes."""
    return spark.read.parquet(folder).where(F.col("doc_id").between(low, high))
