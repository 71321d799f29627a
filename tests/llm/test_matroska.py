import hashlib
import zlib

import pytest

from rivulet.llm import matroska as m
from rivulet.llm import store


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 959, 960, 961, 7680, 7681, 9000, 246_000, 600_000])
def test_round_trip(n):
    payload = m.pad(bytes(i * 7 % 251 for i in range(n)))
    data = m.mux_payload(payload)
    packets = m.parse(data)
    assert b"".join(data[p.start : p.end] for p in packets) == payload
    assert len(payload) % 192 == 0 and payload and all(p.cued and p.track == 1 for p in packets)
    times = [p.time_ms for p in packets]
    assert times == sorted(times) and abs(times[-1] - (len(payload) - (packets[-1].end - packets[-1].start)) * 1000 / m.RATE) < 1.001


def block(lacing, sizes, data):
    head = b"\x81\x00\x05" + bytes([lacing << 1])
    if lacing == 1:
        return head + bytes([len(sizes) - 1]) + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1]) + data
    return head + m.lace([data[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes))])[1]


def test_lacing_groups_and_unknown_sizes():
    sizes = [300, 255, 0, 10]
    data = bytes(range(256)) * 3
    data = data[: sum(sizes)]
    cluster = m.uint(m.CLUSTER_TIME, 100) + m.element(m.SIMPLE_BLOCK, block(1, sizes, data)) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block(3, sizes, data)))
    unknown = m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    file = m._HEADER + m.SEGMENT.to_bytes(4, "big") + b"\xff" + m._TRACKS + unknown + unknown
    packets = m.parse(file)
    assert [p.end - p.start for p in packets] == sizes * 4
    assert [file[p.start : p.end] for p in packets[:4]] == [data[:300], data[300:555], b"", data[555:]]
    assert packets[0].time_ms == 105 and {p.cluster for p in packets} == {0, 1} and [p.lacing for p in packets[:5:4]] == [1, 3]


def test_damage_is_an_error():
    data = m.mux_payload(m.pad(b"x" * 5000))
    with pytest.raises(ValueError):
        m.parse(data[:-700])


def test_vint():
    for v in (0, 1, 126, 127, 16382, 16383, 1 << 40):
        assert m.read_vint(m.vint(v), 0)[:2] == (v, len(m.vint(v)))


def by_hand(text):
    """Feature, stored bytes and payload written from the format: frames of 960 bytes, 8 to a laced block, 32 blocks to a cluster."""
    p = m.pad((text or "").encode())
    frames = -(-len(p) // 960)
    blocks = -(-frames // 8)
    clusters = -(-blocks // 32)
    laced = sum(min(8, frames - 8 * b) for b in range(blocks) if min(8, frames - 8 * b) > 1)
    x = [v - 128 for v in p]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    shown = f"packets={frames};clusters={clusters};cued={clusters};laced={laced};ms={len(p) * 1000 // 48000};sum={sum(x)};energy={sum(v * v for v in x)};crossings={crossings}"
    return len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), shown


def test_query(docs, docs_rows):
    stored = store.materialize(m.mux(docs), "media")
    rows = m.digests(m.packet_lists(stored)).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in rows), key=str)
    assert got == sorted(((i, *by_hand(t)) for i, t, *_ in docs_rows), key=str)
    files = {hashlib.sha256(bytes(r.media)).hexdigest(): len(r.media) for r in stored.collect()}
    assert {(r.media_sha256, r.media_bytes) for r in rows} == set(files.items())
    assert len({r.payload_sha256 for r in rows}) == len({(r.media_sha256, r.feature) for r in rows})


def test_packet_table_empty_and_clashing(docs, no_docs):
    from pyspark.sql import functions as F

    media = m.mux(docs)
    table = m.packets(media).collect()
    assert {r.track for r in table} == {1}
    for r in media.filter("doc_id in (112, 113)").collect():
        own = [p for p in table if p.doc_id == r.doc_id]
        assert own and {p.packet for p in own} == set(range(max(p.packet for p in own) + 1)) and all(0 < p.start < p.end for p in own)
    assert m.digests(m.packet_lists(m.mux(no_docs))).collect() == [] and m.packets(m.mux(no_docs)).collect() == []
    assert m.mux(docs.withColumn("media", F.lit(1)).withColumn("n_bytes", F.lit(2)).withColumn("packets", F.lit(3))).count() == docs.count()
    assert m.digests(m.packet_lists(media.withColumn("media", F.lit(None).cast("binary")))).collect() == []
