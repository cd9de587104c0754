"""Media columns in Matroska: a writer for 8-bit samples and a reader of packet tables.

A text's UTF-8 bytes, padded with spaces to whole frames, become an 8-bit PCM track: an
EBML header, then a segment with info, one track, clusters of laced simple blocks, and a
cue for each cluster. The reader walks variable-length EBML elements (unknown sizes too),
undoes all four kinds of lacing and reads the cues, which it counts but does not seek by; it returns one row per packet with
its track, timestamp and byte range, from which the samples are read back.

Nulls: a null text is the empty text, which is one frame of spaces; a null media value
has no packets and null results; a null or repeated ``doc_id`` is handed through, row by
row. Media that are no Matroska, or end early, raise an error. An empty table gives an
empty result. Other columns are ignored. Equal texts give equal media.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import crc, texts

FRAME, RATE = 192, 8000
LACED, IN_CLUSTER = 8, 128  # frames in a block and in a cluster

#: Element ids of the format, fixed.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
ENTRY, NUMBER, UID, KIND, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    start: int
    size: int
    key: bool
    cluster: int


class Media(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, dict]
    clusters: list[int]
    cues: list[tuple[int, int, int]]
    duration_ns: int


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (1 << 7 * width | n).to_bytes(width, "big")


def _id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def element(i: int, data: bytes) -> bytes:
    return _id(i) + _size(len(data)) + data


def _number(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEADER = element(
    EBML,
    _number(VERSION, 1) + _number(READ_VERSION, 1) + _number(MAX_ID, 4) + _number(MAX_SIZE, 8)
    + element(DOC_TYPE, b"matroska") + _number(DOC_VERSION, 4) + _number(DOC_READ, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        ENTRY,
        _number(NUMBER, 1) + _number(UID, 1) + _number(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT")
        + element(AUDIO, element(FREQUENCY, struct.pack(">d", RATE)) + _number(CHANNELS, 1) + _number(DEPTH, 8)),
    ),
)


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frames of one block: 0 none, 1 Xiph sizes, 2 equal sizes, 3 EBML sizes."""
    if kind == 0:
        return b"".join(frames)
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3 and len(frames) > 1:
        head += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = 1
            while abs(b - a) > (1 << 7 * width - 1) - 1:
                width += 1
            head += (1 << 7 * width | b - a + (1 << 7 * width - 1) - 1).to_bytes(width, "big")
    return head + b"".join(frames)


def block(track: int, time: int, frames: list[bytes], kind: int) -> bytes:
    return _size(track) + struct.pack(">hB", time, 0x80 | kind << 1) + lace(frames, kind)


def equal_block(track: int, time: int, samples: bytes, n: int) -> bytes:
    """A block of ``n`` frames of one size, which stand in it as they stand in the samples."""
    return _size(track) + struct.pack(">hBB", time, 0x84, n - 1) + samples


def write(samples: bytes) -> bytes:
    """Matroska of whole frames of 8-bit samples."""
    frames = len(samples) // FRAME
    ms = 1000 * FRAME // RATE
    info = element(
        INFO,
        _number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", frames * ms)) + element(MUXER, b"pairlens") + element(WRITER, b"pairlens"),
    )
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for first in range(0, frames, IN_CLUSTER):
        data = [_number(TIMESTAMP, first * ms)]
        for k in range(first, min(first + IN_CLUSTER, frames), LACED):
            n = min(LACED, frames - k)
            own = samples[k * FRAME : (k + n) * FRAME]
            data.append(element(SIMPLE_BLOCK, block(1, (k - first) * ms, [own], 0) if n == 1 else equal_block(1, (k - first) * ms, own, n)))
        cluster = element(CLUSTER, b"".join(data))
        place = _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at)
        cues.append(element(POINT, _number(CUE_TIME, first * ms) + element(CUE_PLACE, place)))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


def _vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """Value, next byte, and whether all value bits are set (size unknown)."""
    if at >= len(data) or not data[at]:
        raise ValueError("not an EBML number")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("the media end within a number")
    value = int.from_bytes(data[at : at + width], "big")
    plain = value & (1 << 7 * width) - 1
    return (value if keep_marker else plain), at + width, plain == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, first byte of the content, end of the content) of each child."""
    while at < end:
        place = at
        i, at, _ = _vint(data, at, True)
        n, at, unknown = _vint(data, at, False)
        stop = at + n
        if unknown:
            stop = end
            if i == CLUSTER:  # ends where the next child of the segment begins
                inner = at
                while inner < end:
                    child, body, _ = _vint(data, inner, True)
                    if child in _TOP:
                        break
                    size, body, _ = _vint(data, body, False)
                    inner = body + size
                stop = min(inner, end)
        if stop > end:
            raise ValueError("an element reaches beyond its parent")
        yield i, place, at, stop
        at = stop


def _unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def _unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    if kind == 0:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise ValueError("a block of equal frames has a broken size")
        sizes = [(end - at) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        if n > 1:
            size, at, _ = _vint(data, at, False)
            sizes.append(size)
        for _ in range(n - 2):
            before = at
            delta, at, _ = _vint(data, at, False)
            sizes.append(sizes[-1] + delta - (1 << 7 * (at - before) - 1) + 1)
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames reach beyond their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def read(data: bytes) -> Media:
    """The packet table, tracks, clusters and cues of a Matroska value."""
    packets: list[Packet] = []
    tracks: dict[int, dict] = {}
    clusters: list[int] = []
    cues: list[tuple[int, int, int]] = []
    scale, duration, magic = 1_000_000, 0.0, False

    def frames(a: int, b: int, base: int, key: bool | None) -> None:
        track, a, _ = _vint(data, a, False)
        time, flags = struct.unpack_from(">hB", data, a)
        laced = _unlace(data, a + 3, b, flags >> 1 & 3)
        about = tracks.get(track, {})
        begin = (base + time) * scale
        for start, size in laced:
            packets.append(Packet(track, begin, start, size, bool(flags & 0x80) if key is None else key, len(clusters) - 1))
            # The next frame of the block begins when this one ends: by the track's frame length, or by samples.
            begin += about.get("frame_ns") or size * (about.get("sample_ns") or 0)

    for top, _, a, b in elements(data, 0, len(data)):
        if top == EBML:
            magic = any(i == DOC_TYPE and data[x:y].rstrip(b"\0") in (b"matroska", b"webm") for i, _, x, y in elements(data, a, b))
        if top != SEGMENT:
            continue
        if not magic:
            break
        for i, place, x, y in elements(data, a, b):
            if i == INFO:
                for j, _, p, q in elements(data, x, y):
                    scale = _unsigned(data, p, q) if j == SCALE else scale
                    duration = _float(data, p, q) if j == DURATION else duration
            elif i == TRACKS:
                for j, _, p, q in elements(data, x, y):
                    if j == ENTRY:
                        number, own = _track(data, p, q)
                        tracks[number] = own
            elif i == CLUSTER:
                clusters.append(place - a)
                base = 0
                for j, _, p, q in elements(data, x, y):
                    if j == TIMESTAMP:
                        base = _unsigned(data, p, q)
                    elif j == SIMPLE_BLOCK:
                        frames(p, q, base, None)
                    elif j == GROUP:
                        inner = list(elements(data, p, q))
                        for k, _, r, s in inner:
                            if k == BLOCK:
                                frames(r, s, base, all(c[0] != REFERENCE for c in inner))
            elif i == CUES:
                for j, _, p, q in elements(data, x, y):
                    if j == POINT:
                        cues += _cue(data, p, q)
    if not magic:
        raise ValueError("not Matroska")
    return Media(packets, tracks, clusters, cues, int(duration * scale))


def _track(data: bytes, a: int, b: int) -> tuple[int, dict]:
    own: dict = {"codec": "", "kind": 0, "frame_ns": None, "sample_ns": None}
    number, rate, channels, depth = 0, 8000.0, 1, 8
    for i, _, x, y in elements(data, a, b):
        if i == NUMBER:
            number = _unsigned(data, x, y)
        elif i == KIND:
            own["kind"] = _unsigned(data, x, y)
        elif i == CODEC:
            own["codec"] = data[x:y].decode()
        elif i == 0x23E383:  # default duration of a frame
            own["frame_ns"] = _unsigned(data, x, y)
        elif i == AUDIO:
            for j, _, p, q in elements(data, x, y):
                rate = _float(data, p, q) if j == FREQUENCY else rate
                channels = _unsigned(data, p, q) if j == CHANNELS else channels
                depth = _unsigned(data, p, q) if j == DEPTH else depth
    if own["codec"].startswith("A_PCM") and rate:
        own["sample_ns"] = int(1e9 / rate) * 8 // (channels * depth)
    return number, own


def _cue(data: bytes, a: int, b: int) -> list[tuple[int, int, int]]:
    time, out = 0, []
    for i, _, x, y in elements(data, a, b):
        if i == CUE_TIME:
            time = _unsigned(data, x, y)
        elif i == CUE_PLACE:
            inner = {j: _unsigned(data, p, q) for j, _, p, q in elements(data, x, y)}
            out.append((time, inner.get(CUE_TRACK, 0), inner.get(CUE_CLUSTER, 0)))
    return out


def padded(text: str) -> tuple[int, bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (-len(data) % FRAME if data else FRAME)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text, media: the text's bytes as a Matroska value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                n, samples = padded(text)
                sizes.append(n)
                media.append(write(samples))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet of the column ``media``: doc_id, packet (from 0), track,
    timestamp_ns, start and size of its bytes within the value, key, cluster."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is not None:
                    rows += [(doc_id, k, *p) for k, p in enumerate(read(data).packets)]
            types = [pa.int64()] * 6 + [pa.bool_(), pa.int64()]
            columns = list(zip(*rows)) if rows else [()] * 8
            names = ["doc_id", "packet", "track", "timestamp_ns", "start", "size", "key", "cluster"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return media.select("doc_id", "media").mapInArrow(
        run, "doc_id long, packet long, track long, timestamp_ns long, start long, size long, key boolean, cluster long"
    )


def features(found: Media, samples: bytes) -> str:
    values = np.frombuffer(samples, np.uint8).astype(np.int64)
    matched = sum(place in found.clusters for _, _, place in found.cues)
    last = found.packets[-1].timestamp_ns // 1_000_000 if found.packets else -1
    codecs = ",".join(sorted({t["codec"] for t in found.tracks.values()}))
    return (
        f"{codecs} packets={len(found.packets)} clusters={len(found.clusters)} cues={matched} ms={found.duration_ns // 1_000_000} "
        f"last_ms={last} sum={int(values.sum())} energy={int((values * values).sum())} peak={int(values.max(initial=0))} "
        f"steps={int(np.count_nonzero(np.diff(values)))}"
    )


def describe(media: DataFrame) -> DataFrame:
    """What is read back from each media value: sizes, hashes of samples and value, features."""

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                if data is None:
                    out.append((None,) * 6)
                    continue
                found = read(data)
                samples = b"".join([data[p.start : p.start + p.size] for p in found.packets])
                digest = hashlib.sha256(samples).hexdigest()
                out.append((len(samples), digest, crc(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(found, samples)))
            columns = list(zip(*out)) if out else [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
