"""Fill-in-the-middle texts by displacement scatter.

A text is cut in three at two code points that a hash of its ``doc_id`` picks, and its parts
are written with marks, the middle last: prefix, suffix, middle (``psm``) or suffix, prefix,
middle (``spm``); a share of the texts stays ``plain``.

1. Spark's own functions pick form and cuts of each row; nothing depends on other rows.
2. A batch's texts are one array of UTF-8 bytes. A scan for leading bytes turns the cuts into
   byte places. Each part moves as a whole, so a difference array holds a change of shift at
   each part's first byte; its cumulative sum is every byte's shift, and one scatter writes
   all outputs. Marks fill the gaps.
3. ``restored`` finds the marks in the outputs and gathers the bytes back by the same sums.

Bytes go through in blocks, so memory beyond a batch's texts and outputs is bounded.

Nulls: a null text is the empty text, which is plain; a null ``doc_id`` is hashed as an empty
string; repeated ids get the same draws. A text that holds a mark is plain, so that marks can be
told from text. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, texts

#: Marks of prefix, middle and suffix, fixed.
MARKS = ("<P>", "<M>", "<S>")
BATCH, BLOCK = 1 << 23, 1 << 20
P, M, S = range(3)
#: The order of the parts in each form's output.
ORDERS = {"psm": (P, S, M), "spm": (S, P, M)}


def drawn(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, text, n (code points), form, prefix_chars, middle_chars (null if plain).

    ``plain`` per cent of the rows stay plain, ``spm`` per cent of the others are ``spm``.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)

    def draw(k: int) -> Column:
        return F.conv(F.substring("hashed", 8 * k - 7, 8), 16, 10).cast("long")

    rows = texts(docs).withColumn("hashed", hashed).withColumn("n", F.char_length("text").cast("long"))
    whole = F.col("n") == 0
    for mark in marks:
        whole = whole | F.contains(F.col("text"), F.lit(mark))
    form = F.when(whole | (draw(3) % 100 >= 100 - plain), "plain").when(draw(4) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", form.alias("form"), *((draw(k) % (F.col("n") + 1)).alias(f"cut{k}") for k in (1, 2)))
    moved = F.col("form") != "plain"
    first, last = F.least("cut1", "cut2"), F.greatest("cut1", "cut2")
    return rows.select(
        "doc_id", "text", "n", "form", F.when(moved, first).alias("prefix_chars"), F.when(moved, last - first).alias("middle_chars")
    )


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings and each one's bounds among them."""
    column = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(data)]
    ).cast(pa.binary()).cast(pa.string())


def char_places(data: np.ndarray, at: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The byte that is ``chars`` code points after the start of a text at byte ``at``."""
    lead = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
    return lead[np.searchsorted(lead, at) + chars]


def shifts(n: int, at: np.ndarray, shift: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, shift of each element) by blocks of 0..n, where from each place in ``at`` (ascending)
    on elements move by ``shift``; of several at one place the last holds."""
    change = np.diff(shift, prepend=0)
    for first in range(0, n, BLOCK):
        end = min(n, first + BLOCK)
        a, b = np.searchsorted(at, (first, end))
        steps = np.zeros(end - first, np.int64)
        np.add.at(steps, at[a:b] - first, change[a:b])
        steps[0] += shift[a - 1] if a else 0
        yield first, end, np.cumsum(steps, out=steps)


def scatter(data: np.ndarray, bounds: np.ndarray, form: list[str], cuts: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The outputs' bytes and bounds. ``cuts``: (2, texts) byte places where middle and suffix begin."""
    begin, end = bounds[:-1], bounds[1:]
    starts = np.stack([begin, cuts[0], cuts[1]])
    sizes = np.stack([cuts[0], cuts[1], end]) - starts
    moved = np.array([f != "plain" for f in form], bool)
    extra = np.where(moved, sum(map(len, marks)), 0)
    out_bounds = np.zeros(len(bounds), np.int64)
    np.cumsum(end - begin + extra, out=out_bounds[1:])
    to = starts + (out_bounds[:-1] - begin)  # plain texts move whole
    out = np.empty(out_bounds[-1], np.uint8)
    for name, order in ORDERS.items():
        own = np.flatnonzero([f == name for f in form])
        place = out_bounds[own]
        for part in order:
            for k, byte in enumerate(marks[part]):
                out[place + k] = byte
            to[part, own] = place + len(marks[part])
            place = to[part, own] + sizes[part, own]
    for a, b, shift in shifts(len(data), starts.T.reshape(-1), (to - starts).T.reshape(-1)):
        shift += np.arange(a, b)
        out[shift] = data[a:b]
    return out, out_bounds


def gather(data: np.ndarray, bounds: np.ndarray, form: list[str], marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and bounds, from their outputs and forms alone."""
    begin, end = bounds[:-1], bounds[1:]
    moved = np.array([f != "plain" for f in form], bool)
    starts = np.stack([begin, end, end])  # in the output, by part; a plain text is all prefix
    sizes = np.stack([end - begin, np.zeros_like(begin), np.zeros_like(begin)])
    places = np.zeros((3, len(begin)), np.int64)
    for part, mark in enumerate(marks):
        found = np.flatnonzero(data[: len(data) - len(mark) + 1] == mark[0]) if len(data) >= len(mark) else np.zeros(0, np.int64)
        for k in range(1, len(mark)):
            found = found[data[found + k] == mark[k]]
        which = np.searchsorted(bounds, found, side="right") - 1
        own = moved[which] & (found + len(mark) <= end[which])  # not across two outputs
        found, which = found[own], which[own]
        if len(which) != moved.sum() or (which != np.flatnonzero(moved)).any():
            raise ValueError("an output that is not plain must hold each mark once")
        places[part, which] = found
    for name, order in ORDERS.items():
        own = np.flatnonzero([f == name for f in form])
        for part, following in zip(order, (*order[1:], None)):
            starts[part, own] = places[part, own] + len(marks[part])
            stop = end[own] if following is None else places[following, own]
            sizes[part, own] = stop - starts[part, own]
    out_bounds = np.zeros(len(bounds), np.int64)
    np.cumsum(sizes.sum(axis=0), out=out_bounds[1:])
    to = out_bounds[:-1] + np.stack([np.zeros_like(begin), sizes[P], sizes[P] + sizes[M]])
    out = np.empty(out_bounds[-1], np.uint8)
    for a, b, shift in shifts(len(out), to.T.reshape(-1), (starts - to).T.reshape(-1)):
        shift += np.arange(a, b)
        out[a:b] = data[shift]
    return out, out_bounds


def _checked(marks: tuple[str, ...]) -> list[bytes]:
    """The marks' bytes, if no two can overlap: then the marks found in an output are those put there."""
    own = [m.encode() for m in marks]
    for a in own:
        for b in own:
            if not a or (a is not b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError("marks must not be empty, hold each other or overlap")
    return own


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in chunks(sizes, sizes, BATCH):
        yield batch.slice(a, b - a)


def fill_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (the text in its form)."""
    own = _checked(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "text"):
                data, bounds = _bytes(part.column("text"))
                form = part.column("form").to_pylist()
                prefix, middle = (
                    pc.fill_null(part.column(c), 0).to_numpy(zero_copy_only=False) for c in ("prefix_chars", "middle_chars")
                )
                cuts = np.stack([char_places(data, bounds[:-1], chars) for chars in (prefix, prefix + middle)])
                plain_text = np.array([f == "plain" for f in form], bool)
                cuts = np.where(plain_text, bounds[1:], cuts)
                output = _strings(*scatter(data, bounds, form, cuts, own))
                kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), output], [*kept, "output"])

    rows = drawn(docs, seed, plain, spm, marks)
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(outputs: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``outputs`` with a column ``restored``: the text that each ``output`` and ``form`` stand for.

    A null output or form gives the empty text or is read as plain."""
    own, names = _checked(marks), outputs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "output"):
                data, bounds = _bytes(part.column("output"))
                form = [f or "plain" for f in part.column("form").to_pylist()]
                text = _strings(*gather(data, bounds, form, own))
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*names, "restored"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema)
    return outputs.mapInArrow(run, f"{schema}, restored string")
