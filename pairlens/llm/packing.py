"""Packing of token ids into windows by best-fit decreasing.

An overlong document is first cut into full windows; the rest of each document is one
piece. Best-fit decreasing looks at nothing but lengths, so the plan is made from the
count of pieces of each length (at most ``window`` numbers, whatever the table's size):
lengths are taken in falling order, a segment tree indexed by remaining capacity finds
the tightest open windows, and windows filled alike are kept together as one pattern
with a count. The plan equals that of placing the pieces one by one. Spark then numbers
the pieces of each length and looks their window and offset up in the plan.

Nulls: a null text is the empty text, whose piece holds the end id alone; a null
``doc_id`` is handed through, and rows with the same id are packed each on its own. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, crc, texts
from .tokens import encoder

#: Pieces of one length that are numbered together.
BLOCK_ROWS = 500


class CapacityTree:
    """Open windows counted by remaining capacity; finds the tightest that fits."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = self.leaves + least
        if self.count[i]:
            return least
        while i > 1:  # up to the first right neighbour that holds a window, then down its left side
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (windows, [(length, pieces in a row), ...]) for pieces counted by length."""
    tree = CapacityTree(window)
    open_at: dict[int, list[tuple[tuple, int]]] = {}
    closed: list[tuple[tuple, int]] = []

    def put(pattern: tuple, n: int, capacity: int) -> None:
        if capacity:
            open_at.setdefault(capacity, []).append((pattern, n))
            tree.add(capacity, n)
        else:
            closed.append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                pattern, n, capacity = None, left, window
            else:
                pattern, n = open_at[capacity].pop()
                tree.add(capacity, -n)
            # The tightest window stays the tightest until the length no longer fits.
            row = capacity // length
            used = min(n, left // row)
            if used:
                put((pattern, length, row), used, capacity - row * length)
                left -= used * row
                n -= used
            if n and 0 < left < row:
                put((pattern, length, left), 1, capacity - left * length)
                left, n = 0, n - 1
            if n and capacity < window:
                put(pattern, n, capacity)
    for capacity in sorted(open_at):
        closed += open_at[capacity]
    out = []
    for pattern, n in closed:
        rows = []
        while pattern is not None:
            pattern, length, row = pattern
            rows.append((length, row))
        out.append((n, rows[::-1]))
    return out


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length, runs of piece numbers with their first window, offset and total."""
    given: dict[int, int] = {}
    out, window = [], 0
    for n, rows in patterns:
        offset, total = 0, sum(length * row for length, row in rows)
        for length, row in rows:
            first = given.get(length, 0)
            out.append((length, first, window, row, offset, total))
            given[length] = first + n * row
            offset += length * row
        window += n
    table = np.array(sorted(out), np.int64).reshape(-1, 6)
    return dict(zip(("length", "first", "window", "row", "offset", "total"), table.T.copy()))


def pieces(docs: DataFrame, path: str, end_id: int, window: int, with_ids: bool) -> DataFrame:
    """Each document's ids with the end id, cut: full windows, then what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            ids, bounds = code.encode(batch.column(1).to_pylist())
            end = np.array([end_id], "<u4")
            rows: list[tuple] = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                own = np.append(ids[a:b].astype("<u4"), end)
                for start in range(0, len(own), window):
                    piece = own[start : start + window]
                    rows.append((doc_id, start, len(piece), crc(piece), len(own), piece.tobytes() if with_ids else None))
            columns = list(zip(*rows)) if rows else [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str, end_id: int, window: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id,
    offset, sequence_tokens (all ids in its window) and padded_tokens.

    A window is padded to ``window`` ids, but for one whose ids number a power of two.
    """
    spark = docs.sparkSession
    cut = Scratch(spark, "packing").keep(pieces(docs, path, end_id, window, with_ids), "pieces")
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = slots(best_fit_decreasing(counts, window))
    shared = spark.sparkContext.broadcast(plan)

    # Piece numbers: a frequent length is numbered in blocks of about BLOCK_ROWS rows.
    parts = spark.createDataFrame(
        [(int(n), -(-int(k) // BLOCK_ROWS)) for n, k in counts.items()] or [(0, 1)], "length long, parts long"
    )
    dealt = cut.join(F.broadcast(parts), "length").withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("parts"))
    )
    sizes = dealt.groupBy("length", "block").agg(F.count("*").alias("own"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    numbered = (
        dealt.withColumn("number", F.row_number().over(within))
        .join(bases, ["length", "block"])
        .withColumn("number", F.col("number") + F.col("base") - 1)
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "number")
    )

    def run(batches):
        plan = shared.value
        key = plan["length"] * (1 << 48) + plan["first"]
        for batch in batches:
            length = batch.column(2).to_numpy(zero_copy_only=False)
            number = batch.column(6).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length * (1 << 48) + number, side="right") - 1
            nth = number - plan["first"][at]
            row = plan["row"][at]
            total = plan["total"][at]
            padded = np.where((total & (total - 1)) == 0, total, window)
            added = [plan["window"][at] + nth // row, plan["offset"][at] + nth % row * length, total, padded]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], *(pa.array(c, pa.int64()) for c in added)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset", "sequence_tokens", "padded_tokens"],
            )

    return numbered.mapInArrow(
        run,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, "
        "sequence_id long, offset long, sequence_tokens long, padded_tokens long",
    )
