import hashlib
import struct
import zlib

import pytest

from collonade.llm import matroska as m


def payload(text):
    raw = (text or "").encode()
    return raw, raw + bytes(-len(raw) % 64 or 64 * (not raw))


def test_round_trip(odd):
    got = m.digests(m.parse(m.store(odd))).collect()
    want = []
    for r in odd.collect():
        raw, padded = payload(r.text)
        want.append((r.doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    key = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], key=key) == sorted(want, key=key)
    assert len({(r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_empty_table(nothing):
    assert m.packet_table(m.parse(m.store(nothing))).count() == 0


def test_packets_have_times_and_ranges(spark):
    df = spark.createDataFrame([(1, "a" * 140_000)], "doc_id bigint, text string")
    parsed = m.parse(m.store(df))
    rows = sorted(m.packet_table(parsed).collect(), key=lambda r: r.offset)
    assert [r.timestamp_ns for r in rows] == [i * 64_000_000 for i in range(len(rows))]
    assert sum(r.length for r in rows) == len(payload("a" * 140_000)[1])
    one = parsed.first()
    assert all(one.media[c.cluster_offset : c.cluster_offset + 4] == m.CLUSTER.to_bytes(4, "big") for c in one.cues)
    assert {r.cluster for r in rows} == set(range(len(one.cues)))


def block(lacing, body):
    return m.element(m.SIMPLE_BLOCK, m.vint(1) + struct.pack(">hB", 5, lacing << 1) + body)


@pytest.mark.parametrize(
    "lacing, body, sizes",
    [
        (0, b"abc", [3]),
        (1, bytes([2, 255, 45, 2]) + b"a" * 300 + b"bb" + b"c", [300, 2, 1]),
        (2, bytes([2]) + b"abcdef", [2, 2, 2]),
        (3, bytes([2]) + m.vint(300) + m.signed_vint(-290) + b"a" * 300 + b"b" * 10 + b"c", [300, 10, 1]),
    ],
)
@pytest.mark.parametrize("known", [True, False])
def test_lacing_and_unknown_sizes(lacing, body, sizes, known):
    inside = m.number(m.CLUSTER_TIME, 7) + block(lacing, body)
    cluster = m.element(m.CLUSTER, inside) if known else m.CLUSTER.to_bytes(4, "big") + b"\xff" + inside
    parts = m.TRACK_BYTES + cluster + cluster
    raw = m.HEADER + (m.element(m.SEGMENT, parts) if known else m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + parts)
    got = m.parse_bytes(raw)["packets"]
    assert [p[7] for p in got] == sizes * 2
    assert [p[1] for p in got] == [0] * len(sizes) + [1] * len(sizes)
    assert got[0][2] == 12_000_000


@pytest.mark.parametrize("raw", [None, b"", b"\x00", b"text", m.build(b"x" * 64)[:-9]])
def test_damaged_files_are_reported(spark, raw):
    r = m.parse(spark.createDataFrame([(1, raw)], "doc_id int, media binary")).first()
    assert r.packets == [] and (r.media_error is not None or raw == b"")


def test_clashing_names_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a text", "x", 5), (1, "a text", "x", 5), (2, "y" * 200_000, None, None)], "doc_id bigint, text string, packets string, samples int")
    stored = m.store(docs)
    clashing = stored.withColumn("packets", stored["doc_id"]).withColumn("tracks", stored["doc_id"]).withColumn("media_error", stored["doc_id"])
    got = sorted(map(tuple, m.digests(m.parse(clashing)).collect()))
    assert got == sorted(map(tuple, m.digests(m.parse(stored)).collect())) and len(got) == 3 and got[0] == got[1]
    assert m.parse(stored.withColumnRenamed("media", "samples"), "samples").where("media_error IS NULL").count() == 3
    assert m.digests(m.parse(m.store(docs.limit(0)))).count() == 0


def test_key_frames_of_block_groups():
    """A block in a group is a key frame unless the group refers to another block, before or after it."""
    block = m.element(m.BLOCK, b"\x81\x00\x00\x00abc")
    refers = m.element(m.REFERENCE_BLOCK, b"\xff")
    groups = [m.element(m.BLOCK_GROUP, x) for x in (block, block + refers, refers + block, block)]
    cluster = m.element(m.CLUSTER, m.number(m.CLUSTER_TIME, 0) + b"".join(groups))
    packets = m.parse_bytes(m.element(m.SEGMENT, cluster))["packets"]
    assert [p[3] for p in packets] == [True, False, False, True]
