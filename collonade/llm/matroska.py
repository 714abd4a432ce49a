"""Media columns in Matroska: samples in, packet tables out.

A file is a tree of EBML elements (variable-length id, variable-length size,
payload).  ``store`` writes 8-bit PCM samples into clusters of laced blocks with
cues; ``parse`` reads any file of that kind into tracks, packets and cues, where
a packet is one frame with its track, timestamp and byte range, so that samples
can be fetched by range without reading the rest.

Defined results: a null text is stored as one block of 64 zero bytes; a null or
damaged file has no packets and a ``media_error``; texts and files of any length are
read whole; repeated rows are stored and read each for themselves; an empty table gives
none; ``store`` carries only the key, and the columns that ``parse`` adds replace others of
their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C
CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES}

PAD, RATE, FRAME, LACED, BLOCKS = 64, 8000, 512, 8, 32

PACKET = pa.struct([("track", pa.int64()), ("cluster", pa.int32()), ("timestamp_ns", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
TRACK = pa.struct([("track", pa.int64()), ("type", pa.int64()), ("codec", pa.string()), ("rate", pa.float64()), ("channels", pa.int64()), ("bit_depth", pa.int64()), ("frame_ns", pa.int64())])
CUE = pa.struct([("time", pa.int64()), ("track", pa.int64()), ("cluster_offset", pa.int64())])
PARSED = "tracks array<struct<track:bigint,type:bigint,codec:string,rate:double,channels:bigint,bit_depth:bigint,frame_ns:bigint>>, packets array<struct<track:bigint,cluster:int,timestamp_ns:bigint,keyframe:boolean,lacing:int,frame:int,offset:bigint,length:bigint>>, cues array<struct<time:bigint,track:bigint,cluster_offset:bigint>>, samples binary, media_error string"


def vint(n: int) -> bytes:
    """A size in as few bytes as it needs; all ones would mean an unknown size."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(tag: int, payload: bytes) -> bytes:
    return tag.to_bytes((tag.bit_length() + 7) // 8, "big") + vint(len(payload)) + payload


def number(tag: int, n: int) -> bytes:
    return element(tag, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], relative: int) -> bytes:
    """A SimpleBlock of track 1: no lacing, equal frames, or sizes as EBML differences."""
    equal = len({len(x) for x in frames}) == 1
    lacing = 0 if len(frames) == 1 else 2 if equal else 3
    head = vint(1) + struct.pack(">hB", relative, 0x80 | lacing << 1)
    if lacing:
        head += bytes([len(frames) - 1])
    if lacing == 3:
        head += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            head += signed_vint(len(b) - len(a))
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def signed_vint(d: int) -> bytes:
    width = 1
    while not -(1 << 7 * width - 1) < d < (1 << 7 * width - 1):
        width += 1
    return (d + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")


HEADER = element(EBML, element(DOC_TYPE, b"matroska"))
TRACK_BYTES = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def build(samples: bytes) -> bytes:
    """A file of one 8-bit track, in clusters of at most BLOCKS blocks, with a cue for each."""
    info = element(INFO, number(TIMESTAMP_SCALE, 10**6) + element(DURATION, struct.pack(">d", len(samples) * 1000 / RATE)))
    body, cues, at = [info, TRACK_BYTES], [], len(info) + len(TRACK_BYTES)
    span, step = FRAME * LACED * BLOCKS, FRAME * LACED
    for start in range(0, len(samples), span):
        ms = start * 1000 // RATE
        blocks = [number(CLUSTER_TIME, ms)]
        for b in range(start, min(start + span, len(samples)), step):
            part = samples[b : b + step]
            blocks.append(laced([part[i : i + FRAME] for i in range(0, len(part), FRAME)], (b - start) * 1000 // RATE))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, ms) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return HEADER + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def read_vint(buf: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, next position, and whether all bits are set (an unknown size)."""
    first = buf[at]
    if not first:
        raise ValueError(f"no vint at {at}")
    width = 9 - first.bit_length()
    if at + width > len(buf):
        raise ValueError(f"cut off at {at}")
    raw = int.from_bytes(buf[at : at + width], "big")
    value = raw & ((1 << 7 * width) - 1)
    return (raw if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def frame_sizes(buf: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block, and where the first one starts."""
    if not lacing:
        return [end - at], at
    count, at = buf[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise ValueError(f"uneven fixed lacing at {at}")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if lacing == 1:
            n = 0
            while buf[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + buf[at], at + 1
        else:
            start = at
            n, at, _ = read_vint(buf, at)
            if k:
                n += sizes[-1] - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"frames larger than their block at {at}")
    return sizes, at


def parse_bytes(buf: bytes) -> dict:
    """Walk the elements of one file; see PACKET, TRACK and CUE for what is gathered."""
    tracks: list[dict] = []
    packets: list[tuple] = []
    cues: list[dict] = []
    scale, base, cluster, segment = 10**6, 0, -1, 0
    group, refers = 0, False  # first packet of the last block group, and whether it refers to another block
    ends, at = [(len(buf), 0)], 0
    while at < len(buf):
        while at >= ends[-1][0] and len(ends) > 1:
            ends.pop()
        tag, head, _ = read_vint(buf, at, keep_marker=True)
        size, start, unknown = read_vint(buf, head)
        while tag in TOP and ends[-1][1] not in (0, SEGMENT):  # ends an element of unknown size
            ends.pop()
        end = ends[-1][0] if unknown else start + size
        if end > len(buf):
            raise ValueError(f"element at {at} is cut off")
        at = start if tag in MASTERS else end
        if tag in MASTERS:
            ends.append((end, tag))
            if tag == SEGMENT:
                segment = start
            elif tag == CLUSTER:
                cluster, base = cluster + 1, 0
            elif tag == BLOCK_GROUP:
                group, refers = len(packets), False
            elif tag == TRACK_ENTRY:
                tracks.append({})
            elif tag == CUE_POINT:
                cues.append({})
        elif tag in (SIMPLE_BLOCK, BLOCK):
            track, pos, _ = read_vint(buf, start)
            relative, flags = struct.unpack_from(">hB", buf, pos)
            lacing = flags >> 1 & 3
            sizes, pos = frame_sizes(buf, pos + 3, end, lacing)
            each = next((t.get(DEFAULT_DURATION, 0) for t in tracks if t.get(TRACK_NUMBER) == track), 0)
            key = bool(flags & 0x80) if tag == SIMPLE_BLOCK else not refers  # a block in a group is a key frame unless it refers to another
            for k, n in enumerate(sizes):
                packets.append((track, cluster, (base + relative) * scale + k * each, key, lacing, k, pos, n))
                pos += n
        elif tag == REFERENCE_BLOCK:
            refers, packets[group:] = True, [(*p[:3], False, *p[4:]) for p in packets[group:]]
        elif tag in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION, CHANNELS, BIT_DEPTH):
            tracks[-1][tag] = int.from_bytes(buf[start:end], "big")
        elif tag == CODEC_ID:
            tracks[-1][tag] = buf[start:end].decode("utf-8", "replace")
        elif tag == SAMPLING:
            tracks[-1][tag] = struct.unpack(">d" if size == 8 else ">f", buf[start:end])[0]
        elif tag == TIMESTAMP_SCALE:
            scale = int.from_bytes(buf[start:end], "big")
        elif tag == CLUSTER_TIME:
            base = int.from_bytes(buf[start:end], "big")
        elif tag in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            cues[-1][tag] = int.from_bytes(buf[start:end], "big") + (segment if tag == CUE_CLUSTER else 0)
    return {"tracks": tracks, "packets": packets, "cues": cues}


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's bytes, zero-padded to a positive multiple of 64, as a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                raw = raw or b""
                sizes.append(len(raw))
                media.append(build(raw + bytes(-len(raw) % PAD or PAD * (not raw))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(write, f"`{key}` {kind}, n_bytes bigint, media binary")


ADDED = ("tracks", "packets", "cues", "samples", "media_error")


def parse(media: DataFrame, column: str = "media") -> DataFrame:
    """Add tracks, packets, cues, the samples of the first track read back by byte range, and media_error, in place of columns of these names."""
    media = media.select(*[F.col(f"`{c}`") for c in media.columns if c == column or c not in ADDED])
    if column in ADDED:
        media, column = media.withColumnRenamed(column, "media"), "media"
    names = media.columns

    def lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
        flat = [x for row in rows for x in row]
        parts = [pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True), kind, strict=True)] if flat else [pa.array([], f.type) for f in kind]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(kind)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tracks, packets, cues, samples, errors = [], [], [], [], []
            for raw in batch.column(names.index(column)).to_pylist():
                got, error = {"tracks": [], "packets": [], "cues": []}, None
                try:
                    if raw is None:
                        raise ValueError("no file")
                    got = parse_bytes(raw)
                except (ValueError, IndexError, struct.error) as e:
                    error = str(e)
                tracks.append([tuple(t.get(k) for k in (TRACK_NUMBER, TRACK_TYPE, CODEC_ID, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION)) for t in got["tracks"]])
                packets.append(got["packets"])
                cues.append([tuple(c.get(k) for k in (CUE_TIME, CUE_TRACK, CUE_CLUSTER)) for c in got["cues"]])
                first = tracks[-1][0][0] if tracks[-1] else None
                samples.append(b"".join(raw[p[6] : p[6] + p[7]] for p in got["packets"] if p[0] == first) if not error else None)
                errors.append(error)
            new = [lists(tracks, TRACK), lists(packets, PACKET), lists(cues, CUE), pa.array(samples, pa.binary()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *ADDED])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(read, f"{kept}, {PARSED}")


def packet_table(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a packet: key, track, cluster, timestamp_ns, keyframe, lacing, frame, offset, length."""
    return parsed.select(key, F.explode("packets").alias("p")).select(key, "p.*")


def digests(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """What op1 returns, from the files and what was read back of them."""
    last = F.expr(f"substring(samples, greatest(1, length(samples) - {PAD - 1}), {PAD})")
    feature = F.concat_ws(":", F.size("packets"), F.size("cues"), F.expr("aggregate(packets, 0L, (a, p) -> a + p.length)"), F.expr("coalesce(element_at(packets, -1).timestamp_ns, 0L)"), F.expr("size(array_distinct(transform(packets, p -> p.lacing)))"), F.crc32("samples"))
    return parsed.select(
        key,
        "n_bytes",
        F.length("samples").cast("bigint").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(last).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


