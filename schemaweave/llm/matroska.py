"""Matroska files in a binary column: a writer, and a parser of EBML elements into packet tables.

The parser reads variable-length element ids and sizes (unknown sizes of segments and clusters too), clusters with
SimpleBlocks and BlockGroups, all four lacings (none, Xiph, fixed, EBML), tracks and cues, and gives one row per frame:
number, track, timestamp, byte range in the file, cluster, lacing and whether a cue points at its cluster.

The writer stores bytes as 8-bit PCM: 192-byte frames (24 ms at 8 kHz), up to eight to a block, the lacing of a block by
its number, ten blocks to a cluster, one cue per cluster.

The frames of a lace follow each other by their track's default duration; where a track has none, they share the time stamp
of their block.

Contract: null texts are empty (one frame of spaces); null or truncated files give the packets that are whole and an
``error`` (digests: of these packets, with the error in the feature string; all null for a null file); rows are kept one for
one; extra columns are ignored; an empty table gives no rows. Batches go through in slices of a few MB, so memory is that of
a slice or one file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices

# Element ids of the public Matroska specification: fixed values.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

FRAME, LACED, BLOCKS, FRAME_MS = 192, 8, 10, 24
NONE, XIPH, FIXED, EBML_LACING = range(4)


def element_id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """A size: the shortest form, or ``width`` bytes; all ones is kept for unknown sizes."""
    width = width or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(n: int, body: bytes) -> bytes:
    return element_id(n) + vint(len(body)) + body


def uint(n: int, value: int) -> bytes:
    return element(n, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def signed_vint(n: int) -> bytes:
    width = next(k for k in range(1, 9) if -(1 << 7 * k - 1) < n < 1 << 7 * k - 1)
    return vint(n + (1 << 7 * width - 1) - 1, width)


def laced_block(track: int, relative: int, frames: list[int], body: bytes, lacing: int) -> bytes:
    """A SimpleBlock of frames of the given sizes, which lie one after another in ``body``."""
    head = vint(track) + struct.pack(">hB", relative, 0x80 | lacing << 1)
    if lacing != NONE:
        head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in frames[:-1])
    elif lacing == EBML_LACING:
        head += vint(frames[0]) + b"".join(signed_vint(b - a) for a, b in zip(frames, frames[1:-1], strict=False))
    return element(SIMPLE_BLOCK, head + body)


_HEAD = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
_INFO = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", 8000.0)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """A Matroska file of ``payload``, whose length is a positive multiple of FRAME."""
    clusters, cues, at, step = [], [], len(_INFO) + len(_TRACKS), FRAME * LACED
    for c in range(0, len(payload), step * BLOCKS):
        blocks, start = [uint(TIMESTAMP, c // FRAME * FRAME_MS)], c
        for b in range(c, min(c + step * BLOCKS, len(payload)), step):
            body = payload[b : b + step]
            frames = [FRAME] * (len(body) // FRAME)
            blocks.append(laced_block(1, (b - start) // FRAME * FRAME_MS, frames, body, NONE if len(frames) == 1 else 1 + b // step % 3))
        clusters.append(element(CLUSTER, b"".join(blocks)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, c // FRAME * FRAME_MS) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        at += len(clusters[-1])
    return _HEAD + element(SEGMENT, _INFO + _TRACKS + b"".join(clusters) + element(CUES, b"".join(cues)))


class Truncated(ValueError):
    """An element goes beyond the end of the file."""


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not data[at]:
        raise Truncated(f"no element id at {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > end:
        raise Truncated(f"no element id at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_vint(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """The value, None if it is the unknown size, and where it ends."""
    if at >= end or not data[at]:
        raise Truncated(f"no size at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Truncated(f"no size at {at}")
    value = int.from_bytes(data[at : at + width], "big") ^ 1 << 7 * width
    return None if value == (1 << 7 * width) - 1 else value, at + width


def children(data: bytes, at: int, end: int, until: tuple[int, ...] = ()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, start of the body, end) of the elements between two offsets; stops before an id in ``until``, which ends an element of unknown size."""
    while at < end:
        start = at
        n, at = read_id(data, at, end)
        if n in until:
            return
        size, body = read_vint(data, at, end)
        at = end if size is None else body + size
        if at > end:
            raise Truncated(f"element at {start} goes beyond {end}")
        if size is None and n in (SEGMENT, CLUSTER):
            at = body
            for *_, at in children(data, body, end, () if n == SEGMENT else (CLUSTER, CUES, TRACKS, INFO)):
                pass
        yield n, start, body, at


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first one starts."""
    if lacing == NONE:
        return [end - at], at
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise Truncated(f"frames at {at} differ in size")
        return [(end - at) // count] * count, at
    if lacing == XIPH:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:
        for k in range(count - 1):
            if k == 0:
                n, at = read_vint(data, at, end)
                sizes.append(n)
            else:
                width = 9 - data[at].bit_length()
                n, at = int.from_bytes(data[at : at + width], "big") ^ 1 << 7 * width, at + width
                sizes.append(sizes[-1] + n - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Truncated(f"frames at {at} go beyond {end}")
    return sizes, at


def parse(data: bytes | None) -> dict:
    """tracks, cues (time, cluster position in the file), packets (track, timestamp, byte_start, byte_length, cluster, lacing), clusters, error."""
    out: dict = {"tracks": [], "cues": [], "packets": [], "clusters": [], "error": None}
    if data is None:
        return out | {"error": "no file"}
    number = lambda body, stop: int.from_bytes(data[body:stop], "big")
    scale = 1_000_000
    durations: dict[int, int] = {}  # nanoseconds a frame

    def block(body: int, stop: int, time: int, cluster: int) -> None:
        track, at = read_vint(data, body, stop)
        relative, flags = struct.unpack_from(">hB", data, at)
        lacing = flags >> 1 & 3
        sizes, at = lace_sizes(data, at + 3, stop, lacing)
        stamp = (time + relative) * scale // 1_000_000
        for k, n in enumerate(sizes):
            out["packets"].append((track, stamp + k * durations.get(track, 0) // 1_000_000, at, n, cluster, lacing))
            at += n

    try:
        for n, _, body, stop in children(data, 0, len(data)):
            if n != SEGMENT:
                continue
            for n, start, inner, end in children(data, body, stop):
                if n == INFO:
                    scale = next((number(b, e) for k, _, b, e in children(data, inner, end) if k == TIMESTAMP_SCALE), scale)
                elif n == TRACKS:
                    out["tracks"] += [{k: data[b:e] for k, _, b, e in children(data, x, y)} for k, _, x, y in children(data, inner, end)]
                    durations = {int.from_bytes(t[TRACK_NUMBER], "big"): int.from_bytes(t[DEFAULT_DURATION], "big") for t in out["tracks"] if TRACK_NUMBER in t and DEFAULT_DURATION in t}
                elif n == CUES:
                    for _, _, x, y in children(data, inner, end):
                        point = {k: (b, e) for k, _, b, e in children(data, x, y)}
                        where = {k: (b, e) for k, _, b, e in children(data, *point[CUE_TRACK_POSITIONS])}
                        out["cues"].append((number(*point[CUE_TIME]), body + number(*where[CUE_CLUSTER_POSITION])))
                elif n == CLUSTER:
                    time = 0
                    out["clusters"].append(start)
                    for k, _, x, y in children(data, inner, end):
                        if k == TIMESTAMP:
                            time = number(x, y)
                        elif k == SIMPLE_BLOCK:
                            block(x, y, time, start)
                        elif k == BLOCK_GROUP:
                            for m, _, p, q in children(data, x, y):
                                if m == BLOCK:
                                    block(p, q, time, start)
    except (Truncated, IndexError, KeyError, struct.error, TypeError) as e:
        out["error"] = str(e) or type(e).__name__
    return out


def packet_table(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """One row per frame of each file: file_id, packet, track, timestamp_ms, byte_start, byte_length, cluster_start, lacing, cued, error; a file without frames has one row of nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_id", "packet", "track", "timestamp_ms", "byte_start", "byte_length", "cluster_start", "lacing", "cued", "error"]
        for batch in slices(batches, column="content"):
            for doc, data in zip(batch["file_id"].to_pylist(), batch["content"].to_pylist(), strict=True):
                got = parse(data)
                cued = {x for _, x in got["cues"]}
                rows = [(doc, k, *p[:5], p[5], p[4] in cued, got["error"]) for k, p in enumerate(got["packets"])] or [(doc, *[None] * 8, got["error"])]
                kinds = [batch["file_id"].type, *[pa.int64()] * 7, pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    own = files.select(files[id_col].alias("file_id"), files[content_col].alias("content"))
    return own.mapInArrow(run, f"file_id {own.dtypes[0][1]}, packet long, track long, timestamp_ms long, byte_start long, byte_length long, cluster_start long, lacing long, cued boolean, error string")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as Matroska files: doc_id, n_bytes (of the text), media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, media = [], []
            for text in batch["text"].to_pylist():
                raw = text.encode()
                sizes.append(len(raw))
                media.append(mux(raw + b" " * (-len(raw) % FRAME if raw else FRAME)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = id_text(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, n_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Per file (doc_id, n_bytes, media), from its packets: the digests of the payload and of the file, and a feature string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="media"):
            rows = []
            for doc, n, data in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"].to_pylist(), strict=True):
                got = parse(data)
                if data is None:
                    rows.append((doc, n, *[None] * 6))
                    continue
                payload = b"".join([data[p[2] : p[2] + p[3]] for p in got["packets"]])
                samples = np.frombuffer(payload, np.uint8)
                histogram = np.bincount(samples, minlength=256)
                values = np.arange(256)
                feature = f"packets={len(got['packets'])};clusters={len(got['clusters'])};cues={len(got['cues'])};last_ms={got['packets'][-1][1] if got['packets'] else ''};sum={int(histogram @ values)};energy={int(histogram @ values**2)}"
                feature += f";error={got['error']}" if got["error"] else ""
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = [batch["doc_id"].type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

    return media.mapInArrow(run, f"doc_id {media.dtypes[0][1]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
