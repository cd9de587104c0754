"""Token ids in files coded by a static range asymmetric numeral system.

One table of symbol frequencies, counted over all documents, serves every block. A block
holds up to ``BLOCK`` ids, dealt over ``LANES`` interleaved coder states that share one
stream of 32-bit words; blocks know nothing of each other. A file body begins with a
checkpoint for each block (ids, byte offset, length, crc32), so any block can be decoded
and checked alone, and with the documents it holds. Bodies are rows of a Parquet table,
which any store that Spark reaches can hold.

File body, little-endian: magic ``RAN1``; counts of blocks and documents, ids in all;
checkpoints; documents (id, ids, whether the id is null); crc32 of all that; payloads
(lane states, then words).

Documents are in ascending ``doc_id`` order, null ids last; rows with the same id follow one another
by length and content. A null text is the empty text, whose document holds the end id alone.
An empty table gives no files and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, crc, texts
from .tokens import encoder

SCALE, LANES, BLOCK = 20, 32, 1 << 14
LOW, WORD = np.uint64(1 << 31), np.uint64(32)
_MAGIC = b"RAN1"
_HEAD = struct.Struct("<4sIIQ")
_CHECKPOINT = np.dtype([("n", "<u4"), ("offset", "<u8"), ("length", "<u4"), ("crc", "<u4")])
_DOCUMENT = np.dtype([("id", "<i8"), ("n", "<u8"), ("null", "u1")])


class Frequencies:
    """Counts scaled to 2**SCALE slots, one at least for each symbol that occurs."""

    def __init__(self, counts: np.ndarray):
        slots = 1 << SCALE
        seen = np.flatnonzero(counts)
        share = counts[seen] / max(1, int(counts.sum()))
        f = np.maximum(1, np.floor(share * slots).astype(np.int64))
        order = np.argsort(-f, kind="stable")
        left = slots - int(f.sum()) if len(f) else 0
        while left:
            step = order[: abs(left)] if left > 0 else order[f[order] > 1][: abs(left)]
            f[step] += 1 if left > 0 else -1
            left -= len(step) if left > 0 else -len(step)
        self.freq = np.zeros(len(counts), np.uint64)
        self.freq[seen] = f.astype(np.uint64)
        self.below = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(counts), dtype=np.uint32), self.freq.astype(np.int64))
        self.padding = int(np.argmax(self.freq)) if len(counts) else 0


def encode_blocks(ids: np.ndarray, table: Frequencies) -> list[tuple[int, bytes]]:
    """(ids, payload) of each block of ``ids``; all blocks advance together."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return []
    sizes = [min(BLOCK, len(ids) - i * BLOCK) for i in range(n_blocks)]
    steps = [-(-n // LANES) for n in sizes]
    padded = np.full((n_blocks, steps[0] * LANES), table.padding, np.int64)
    for i, n in enumerate(sizes):
        padded[i, :n] = ids[i * BLOCK : i * BLOCK + n]
    symbols = np.ascontiguousarray(padded.reshape(n_blocks, steps[0], LANES).transpose(1, 0, 2))
    freq, below = table.freq[symbols], table.below[symbols]
    state = np.full((n_blocks, LANES), LOW, np.uint64)
    words = np.zeros(symbols.shape, "<u4")
    out = np.zeros(symbols.shape, bool)
    top, scale = np.uint64(63 - SCALE), np.uint64(SCALE)
    for t in range(steps[0] - 1, -1, -1):
        b = n_blocks if t < steps[-1] else n_blocks - 1
        x, f = state[:b], freq[t, :b]
        full = x >= f << top
        words[t, :b] = x.astype("<u4")
        out[t, :b] = full
        x = np.where(full, x >> WORD, x)
        q = x // f
        state[:b] = (q << scale) + (x - q * f) + below[t, :b]
    return [(sizes[i], state[i].astype("<u8").tobytes() + words[:, i][out[:, i]].tobytes()) for i in range(n_blocks)]


def decode_blocks(blocks: list[tuple[int, bytes]], table: Frequencies) -> np.ndarray:
    """The ids of any blocks, one block after another."""
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    if not order:
        return np.zeros(0, np.uint32)
    steps = [-(-blocks[i][0] // LANES) for i in order]
    state = np.array([np.frombuffer(blocks[i][1], "<u8", LANES) for i in order]).astype(np.uint64)
    streams = [np.frombuffer(blocks[i][1], "<u4", offset=8 * LANES) for i in order]
    at = np.cumsum([0] + [len(s) for s in streams[:-1]])
    stream = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
    out = np.zeros((steps[0], len(order), LANES), np.uint32)
    scale, low = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    b = len(order)
    for t in range(steps[0]):
        while steps[b - 1] <= t:
            b -= 1
        x = state[:b]
        slot = x & low
        symbol = table.symbol[slot.astype(np.int64)]
        out[t, :b] = symbol
        x = table.freq[symbol] * (x >> scale) + slot - table.below[symbol]
        need = x < LOW
        rank = np.cumsum(need, axis=1)
        place = at[:b, None] + rank - 1
        x[need] = (x[need] << WORD) | stream[place[need]]
        at[:b] += rank[:, -1]
        state[:b] = x
    by_place: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for k, i in enumerate(order):
        by_place[i] = out[: steps[k], k].reshape(-1)[: blocks[i][0]]
    return np.concatenate(by_place)


def write_body(documents: list[tuple[int | None, np.ndarray]], table: Frequencies) -> bytes:
    ids = np.concatenate([d[1] for d in documents])
    blocks = encode_blocks(ids, table)
    checks, docs = np.zeros(len(blocks), _CHECKPOINT), np.zeros(len(documents), _DOCUMENT)
    offset = _HEAD.size + checks.nbytes + docs.nbytes + 4
    for i, (n, payload) in enumerate(blocks):
        checks[i] = (n, offset, len(payload), crc(payload))
        offset += len(payload)
    for i, (doc_id, own) in enumerate(documents):
        docs[i] = (doc_id or 0, len(own), doc_id is None)
    head = _HEAD.pack(_MAGIC, len(blocks), len(documents), len(ids)) + checks.tobytes() + docs.tobytes()
    return b"".join([head, struct.pack("<I", crc(head)), *(p for _, p in blocks)])


def read_index(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The checkpoints and the documents of a body, checked."""
    if len(body) < _HEAD.size:
        raise ValueError("too short for a file of coded ids")
    magic, n_blocks, n_docs, n_ids = _HEAD.unpack_from(body)
    end = _HEAD.size + n_blocks * _CHECKPOINT.itemsize + n_docs * _DOCUMENT.itemsize
    if magic != _MAGIC or len(body) < end + 4 or struct.unpack_from("<I", body, end)[0] != crc(body[:end]):
        raise ValueError("not a file of coded ids, or its index is damaged")
    checks = np.frombuffer(body, _CHECKPOINT, n_blocks, _HEAD.size)
    docs = np.frombuffer(body, _DOCUMENT, n_docs, _HEAD.size + checks.nbytes)
    if int(checks["n"].sum()) != n_ids or int(docs["n"].sum()) != n_ids:
        raise ValueError("the index's counts disagree")
    return checks, docs


def read_ids(body: bytes, table: Frequencies, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (not included), each checked on its own."""
    checks, _ = read_index(body)
    blocks = []
    for c in checks[first:last]:
        payload = body[c["offset"] : c["offset"] + c["length"]]
        if crc(payload) != c["crc"]:
            raise ValueError("a block is damaged")
        blocks.append((int(c["n"]), payload))
    return decode_blocks(blocks, table)


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n and ids (32-bit little-endian, or 16-bit where all fit) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        width = "<u2" if max(code.size, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            ids, bounds = code.encode(batch.column(1).to_pylist())
            ids, end = ids.astype(width), np.array([end_id], width).tobytes()
            own = [ids[a:b].tobytes() + end for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            n = np.diff(bounds) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(own, pa.binary())], ["doc_id", "n", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, ids binary")


def _ids(own: bytes, n: int) -> np.ndarray:
    return np.frombuffer(own, f"<u{len(own) // n}").astype(np.uint32)


def count_ids(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs; as many entries as the vocabulary has, at most."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for own, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.bincount(_ids(own, n))
                if len(got) > len(total):
                    total = np.append(total, np.zeros(len(got) - len(total), np.int64))
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "k"])

    counted = tokens.select("ids", "n").mapInArrow(run, "id long, k long").groupBy("id").agg(F.sum("k").alias("k"))
    return {r.id: r.k for r in counted.collect()}


def write_files(tokens: DataFrame, table: Frequencies, scratch: Scratch, ids_in_file: int) -> DataFrame:
    """Files in ascending doc_id order: part, place in the part, ids before it there, body."""
    shared = tokens.sparkSession.sparkContext.broadcast((table.freq, table.below, table.padding))

    def run(batches):
        own = Frequencies.__new__(Frequencies)
        own.freq, own.below, own.padding = shared.value
        part, place, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        n_held = 0

        def body():
            data = write_body(held, own)
            columns = [pa.array([v], pa.int64()) for v in (part, place, first, n_held)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([data], pa.binary())], ["part", "place", "first", "n", "body"])

        for batch in batches:
            for doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((doc_id, _ids(ids, n)))
                n_held += n
                if n_held >= ids_in_file:
                    yield body()
                    place, first, held, n_held = place + 1, first + n_held, [], 0
        if held:
            yield body()

    order = [F.col("doc_id").asc_nulls_last(), F.col("n"), F.col("ids")]
    ordered = tokens.repartitionByRange(order[0]).sortWithinPartitions(*order)
    return scratch.keep(ordered.mapInArrow(run, "part long, place long, first long, n long, body binary"), "files")


def read_files(files: DataFrame, table: Frequencies) -> DataFrame:
    """doc_id, start, n_tokens, ids of each document in the files."""
    shared = files.sparkSession.sparkContext.broadcast((table.freq, table.below, table.symbol))
    totals = files.groupBy("part").agg(F.sum("n").alias("own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part; there are as many as shuffle partitions.
    starts = totals.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))

    def run(batches):
        own = Frequencies.__new__(Frequencies)
        own.freq, own.below, own.symbol = shared.value
        for batch in batches:
            for first, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, docs = read_index(body)
                ids = read_ids(body, own).astype("<u4")
                bounds = np.append(0, np.cumsum(docs["n"].astype(np.int64)))
                pieces = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs["id"].astype(np.int64), pa.int64(), mask=docs["null"].astype(bool)),
                        pa.array(first + bounds[:-1], pa.int64()),
                        pa.array(docs["n"].astype(np.int64), pa.int64()),
                        pa.array([crc(p) for p in pieces], pa.int64()),
                        pa.array(pieces, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    placed = files.join(F.broadcast(starts), "part").select((F.col("first") + F.col("before")).alias("first"), "body")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_files(docs: DataFrame, path: str, end_id: int, ids_in_file: int = 1 << 19) -> tuple[DataFrame, Frequencies]:
    """The files of all documents and the frequencies that they share."""
    scratch = Scratch(docs.sparkSession, "rans")
    tokens = scratch.keep(token_table(docs, path, end_id), "ids")
    seen = count_ids(tokens)
    counts = np.zeros(max(seen, default=0) + 1, np.int64)
    counts[list(seen)] = list(seen.values())
    table = Frequencies(counts)
    files = write_files(tokens, table, scratch, ids_in_file)
    scratch.drop("ids")
    return files, table
