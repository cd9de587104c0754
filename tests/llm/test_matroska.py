import hashlib
import random

import pytest

from pairlens.llm import matroska as m
from pairlens.llm.common import crc


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_lacing_round_trip(kind):
    rng = random.Random(kind)
    for n in (1, 2, 3, 20):
        same = rng.randint(0, 900)
        frames = [rng.randbytes(same if kind == 2 else rng.choice([0, 3, 254, 255, 256, 70, 20_000])) for _ in range(1 if kind == 0 else n)]
        body = m.block(1, 5, frames, kind)
        media = m._HEADER + m.element(m.SEGMENT, m._TRACKS + m.element(m.CLUSTER, m._number(m.TIMESTAMP, 10) + m.element(m.SIMPLE_BLOCK, body)))
        packets = m.read(media).packets
        assert [media[p.start : p.start + p.size] for p in packets] == frames
        assert packets[0].timestamp_ns == 15_000_000 and packets[0].key


def test_unknown_sizes_groups_and_skipped_elements():
    cluster = m._id(m.CLUSTER) + b"\xff" + m._number(m.TIMESTAMP, 1) + m.element(m.GROUP, m.element(m.BLOCK, m.block(2, 0, [b"ab"], 0)) + m._number(m.REFERENCE, 1))
    media = m._HEADER + m.element(0xEC, b"void") + m._id(m.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + cluster + m.element(m.CUES, b"")
    found = m.read(media)
    assert [media[p.start : p.start + p.size] for p in found.packets] == [b"ab", b"ab"]
    assert [p.cluster for p in found.packets] == [0, 1] and not found.packets[0].key


def test_broken_media_raise():
    good = m.write(b" " * 192)
    for bad in (b"RIFF", good[:-3], good.replace(b"matroska", b"matrosky")):
        with pytest.raises(ValueError):
            m.read(bad)


def test_documents_read_back(docs_of):
    texts = ["hello", None, "", "é" * 96, "x" * 192, "y" * 193, "long " * 30_000, "hello"]
    docs = docs_of(texts)
    media = m.to_media(docs)
    got = {r.doc_id: r for r in m.describe(media).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        want = data + b" " * (192 if not data else -len(data) % 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(want))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(want).hexdigest(), crc(want[-16:]))
        assert f"packets={len(want) // 192} " in r.feature
    assert got[0][2:] == got[7][2:]
    packets = m.packet_table(media).where("doc_id = 6").orderBy("packet").collect()
    assert [p.timestamp_ns for p in packets] == [24_000_000 * k for k in range(len(packets))]
    assert {p.size for p in packets} == {192} and packets[-1].cluster == (len(packets) - 1) // m.IN_CLUSTER
    assert "cues=7 " in got[6].feature and "clusters=7 " in got[6].feature


def test_null_media_and_no_rows(spark, docs_of):
    none = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert m.describe(none).first().payload_bytes is None and m.packet_table(none).collect() == []
    assert m.describe(m.to_media(docs_of(["a"]).limit(0))).collect() == []
    assert m.describe(m.to_media(docs_of(["a", "a"], [None, None]))).count() == 2
