"""Ogg media columns: write pages, verify their checksums, reassemble packets, demultiplex, derive timestamps.

A payload of 8-bit samples is stored as packets of 576 samples dealt page by page over two logical streams;
the granule position of a page is the number of samples up to the end of its last packet, so a reader gets
the time of every packet and the order of the streams from granule positions alone.

Cases: a null text counts as empty and gives one packet of padding; very long texts are stored whole; equal
texts give equal bytes; other columns are ignored; an empty table gives an empty result; null and broken media
give null values with the fault in the column ``error`` (the functions on bytes raise it as ``ValueError``).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fluxgrid.llm.bpe import utf8_rows
from fluxgrid.llm.common import id_text, map_arrow

RATE, FRAME, PAD = 8000, 576, 255
SERIALS = (1, 2)
#: Packets on a page; 48 of 576 bytes take 144 of the 255 lacing values.
PAGE_PACKETS = 48
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
HEADER = struct.Struct("<4sBBqIIIB")

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """CRC-32 of polynomial 04C11DB7, not reflected, no inversion: zlib's CRC of mirrored bytes, mirrored."""
    reflected = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    """One page with its checksum."""
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + checksum(whole).to_bytes(4, "little") + whole[26:]


@dataclass
class Stream:
    """Writer of one logical stream."""

    serial: int
    number: int = 0

    def pages(self, packets: list[bytes], granule: int, last: bool = False) -> Iterator[bytes]:
        """Pages that hold whole packets; a packet beyond 255 lacing values continues on the next page.

        ``granule`` is the position at the end of the last packet.
        """
        lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
        body = b"".join(packets)
        flags = FIRST if self.number == 0 else 0
        at = 0
        while lacing:
            part, lacing = lacing[:255], lacing[255:]
            size = sum(part)
            ends = any(x < 255 for x in part)
            more = bool(lacing)
            kind = flags | (LAST if last and not more else 0)
            yield page(self.serial, self.number, kind, granule if ends and not more else NO_GRANULE, part, body[at : at + size])
            at += size
            self.number += 1
            flags = CONTINUED if part[-1] == 255 else 0


def stream_head() -> bytes:
    """First packet of a stream: unsigned 8-bit mono PCM."""
    return struct.pack(">8sHHIIBBHI", b"PCM     ", 0, 0, 1, RATE, 8, 1, FRAME, 0)


def store_payload(payload: bytes) -> bytes:
    """Samples as an Ogg file of two logical streams; ``payload`` is a positive multiple of 576 long."""
    if not payload or len(payload) % FRAME:
        raise ValueError("a payload is a positive multiple of 576 bytes")
    writers = [Stream(s) for s in SERIALS]
    out = [b"".join(w.pages([stream_head()], 0)) for w in writers]
    step = PAGE_PACKETS * FRAME
    starts = range(0, len(payload), step)
    for k, start in enumerate(starts):
        part = payload[start : start + step]
        packets = [part[i : i + FRAME] for i in range(0, len(part), FRAME)]
        out += writers[k % 2].pages(packets, start + len(part), last=k >= len(starts) - 2)
    if len(starts) == 1:  # the other stream ends with an empty page
        out.append(page(SERIALS[1], writers[1].number, LAST, 0, b"", b""))
    return b"".join(out)


@dataclass
class Logical:
    """What a reader knows of one logical stream."""

    head: bytes | None = None
    number: int = 0
    partial: list[bytes] = field(default_factory=list)
    ended: bool = False
    pages: int = 0


@dataclass(frozen=True)
class Packet:
    """A packet with the sample at which it starts."""

    serial: int
    start: int
    data: bytes


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(serial, number, flags, granule, lacing, body) of every page, its checksum verified."""
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise ValueError("a page is cut")
        magic, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        body = at + HEADER.size + count
        lacing = media[at + HEADER.size : body]
        end = body + sum(lacing)
        if end > len(media):
            raise ValueError("a page is cut")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        yield serial, number, flags, granule, lacing, media[body:end]
        at = end


def packets_of(lacing: bytes, body: bytes) -> tuple[list[bytes], bytes | None]:
    """Packets that end on a page, and the part of one that goes on (None: nothing)."""
    done, at, size = [], 0, 0
    for x in lacing:
        size += x
        if x < 255:
            done.append(body[at : at + size])
            at, size = at + size, 0
    return done, body[at : at + size] if lacing and lacing[-1] == 255 else None


def demultiplex(media: bytes) -> tuple[list[Packet], dict[int, Logical]]:
    """Packets of all logical streams in order of time, and the streams."""
    streams: dict[int, Logical] = {}
    out: list[Packet] = []
    for serial, number, flags, granule, lacing, body in read_pages(media):
        s = streams.setdefault(serial, Logical())
        if number != s.number or bool(flags & FIRST) != (number == 0) or s.ended:
            raise ValueError(f"stream {serial}: page {number} is out of order")
        if bool(flags & CONTINUED) != bool(s.partial):
            raise ValueError(f"stream {serial}: page {number} breaks a packet")
        s.number, s.pages, s.ended = number + 1, s.pages + 1, bool(flags & LAST)
        done, rest = packets_of(lacing, body)
        if done and s.partial:
            done[0] = b"".join(s.partial) + done[0]
            s.partial = []
        if rest is not None:
            s.partial.append(rest)
        if s.head is None and done:
            s.head = done.pop(0)
        # a granule position counts samples up to the end of the page's last packet
        end = granule
        for data in reversed(done):
            end -= len(data)
            out.append(Packet(serial, end, data))
    if any(not s.ended or s.partial for s in streams.values()):
        raise ValueError("a stream has no end")
    return sorted(out, key=lambda p: p.start), streams


def read_payload(media: bytes) -> tuple[bytes, list[Packet], dict[int, Logical]]:
    """Samples in order of time; raises if samples are missing."""
    packets, streams = demultiplex(media)
    at = 0
    for p in packets:
        if p.start != at:
            raise ValueError(f"samples {at} to {p.start} are missing")
        at += len(p.data)
    return b"".join(p.data for p in packets), packets, streams


def feature_text(payload: bytes, packets: list[Packet], streams: dict[int, Logical]) -> str:
    """Whole-number features of the samples and the container."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    energy = int((x.astype(np.int64) ** 2).sum())
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={len(packets)};"
        f"ms={len(payload) * 1000 // RATE};last_ms={packets[-1].start * 1000 // RATE};"
        f"sum={int(x.sum())};energy={energy};peak={int(np.abs(x).max())};crossings={crossings}"
    )


def payload_of(text: bytes) -> bytes:
    """Bytes of a text, padded by 255 to a positive multiple of 576."""
    size = max(1, -(-len(text) // FRAME)) * FRAME
    return text + bytes([PAD]) * (size - len(text))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media BINARY: each text as an Ogg file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8_rows(b)
            media = [store_payload(payload_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    rows = id_text(docs, id_col, text_col)
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read(media: bytes | None) -> tuple[bytes, list[Packet], dict[int, Logical]]:
    """Like read_payload; null, empty and cut media raise ``ValueError`` too."""
    if not media:
        raise ValueError("no media")
    payload, found, streams = read_payload(media)
    if not payload:
        raise ValueError("no samples")
    return payload, found, streams


def packets(media: DataFrame) -> DataFrame:
    """doc_id, serial, start, ms, data BINARY, error of every packet of a media column; a broken medium is one row."""
    names = ["doc_id", "serial", "start", "ms", "data", "error"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for k, m in enumerate(b.column("media").to_pylist()):
                try:
                    rows = [(p.serial, p.start, p.start * 1000 // RATE, p.data, None) for p in read(m)[1]]
                except ValueError as e:
                    rows = [(None, None, None, None, str(e))]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                cols = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([k] * len(rows), pa.int64())), *cols], names)

    rows = media.select("doc_id", "media")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, serial long, start long, ms long, data binary, error string")


def features(media: DataFrame) -> DataFrame:
    """Read the stored bytes back: doc_id, n_bytes, digests of payload and media, feature, error."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def row(m: bytes | None) -> tuple:
        stored = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
        try:
            payload, found, streams = read(m)
        except ValueError as e:
            return (None, None, None, *stored, None, str(e))
        digests = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        return (*digests, *stored, feature_text(payload, found, streams), None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(m) for m in b.column("media").to_pylist()]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), *cols], ["doc_id", "n_bytes", *names]
            )

    rows = media.select("doc_id", "n_bytes", "media")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        rows,
        run,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, error string",
    )
