"""Periodic runs of words: a suffix automaton whose last occurrences link-cut access keeps.

A run is a stretch of consecutive words with smallest period q, of ``LEAST`` words and twice
its period at least, that no neighbouring word extends. In each text:

1. Words get numbers that are equal for equal words of a batch (exactly, by a dictionary).
2. A run of ``LEAST`` words or more is covered by strings of ``LEAST // 2`` words that occur
   again in the text, so only stretches that such strings cover go on; the rest hold no run.
3. A stretch's words are appended to a suffix automaton. Each state keeps the end of its last
   occurrence: the states on the path from the new prefix to the root take the new end. A
   link-cut tree over the suffix links holds paths of one colour (one last end), so an append
   recolours a few path segments, O(log n) each, amortised.
4. A segment recoloured from end ``e`` to ``i`` whose longest string has ``L`` words says that the
   last ``L`` words before ``i`` stood before ``e`` too. With q = i - e and L >= q these are two
   periods: the words from i - L - q + 1 to i have period q. As the last occurrence is the
   nearest, q is the smallest period; as L is longest, the stretch goes as far left as it can.
   Its last i is the run's end, so each run comes out whole, with no list of candidates.

Nulls: a null text is the empty text, without runs; a null or repeated ``doc_id`` is handed
through, row by row. An empty table gives an empty result. Other columns are ignored. Memory
is in proportion to a batch's part of about ``BATCH`` bytes, or its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, texts

LEAST = 12
BATCH = 1 << 22
#: What separates words, fixed: the bytes at which ``bytes.split`` splits.
WHITE = r"[\x20\x09-\x0D]+"


class LastEnds:
    """A suffix automaton of appended symbols with a link-cut tree over its suffix links.

    Paths of the tree are splay trees ordered by string length. ``colour`` is the last end of all
    states of a path, held at its splay tree's root; ``up`` of that root is the state above the path.
    """

    def __init__(self):
        self.moves: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.left, self.right, self.up, self.colour = [-1], [-1], [-1], [-1]
        self.end = self.last = 0

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.left.append(-1)
        self.right.append(-1)
        self.up.append(link)
        self.colour.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        while y >= 0 and (left[y] == x or right[y] == x):
            z = up[y]
            inner = z >= 0 and (left[z] == y or right[z] == y)
            if inner:
                # zig-zig turns the upper edge first, zig-zag the lower one twice
                turn = y if (left[y] == x) == (left[z] == y) else x
                self._rotate(turn)
            self._rotate(x)
            y = up[x]

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b >= 0:
            up[b] = y
        up[y], up[x] = x, z
        if z >= 0 and left[z] == y:
            left[z] = x
        elif z >= 0 and right[z] == y:
            right[z] = x
        else:
            self.colour[x] = self.colour[y]

    def _split(self, q: int, length: int) -> int:
        """A copy of state q for its strings of up to ``length`` symbols, just above it on its path."""
        copy = self._state(dict(self.moves[q]), length, self.link[q])
        self.link[q] = copy
        self._splay(q)
        above = self.left[q]
        self.up[copy] = q
        self.left[copy], self.left[q] = above, copy
        if above >= 0:
            self.up[above] = copy
        return copy

    def append(self, symbol: int) -> list[tuple[int, int]]:
        """(longest string's length, end before) of each path segment that the new end recolours."""
        moves, length, link = self.moves, self.length, self.link
        p, end = self.last, self.end
        cur = self._state({}, length[p] + 1, 0)
        while p >= 0 and symbol not in moves[p]:
            moves[p][symbol] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][symbol]
            if length[q] > length[p] + 1:
                copy = self._split(q, length[p] + 1)
                while p >= 0 and moves[p].get(symbol) == q:
                    moves[p][symbol] = copy
                    p = link[p]
                q = copy
            link[cur] = self.up[cur] = q
        self.last, self.end = cur, end + 1
        # Access: join the whole path to the root, cut off what hangs below each segment.
        found = []
        colour, right, up = self.colour, self.right, self.up
        below, x = cur, up[cur]
        while x >= 0:
            self._splay(x)
            before = colour[x]
            if length[x] and before >= 0:
                found.append((length[x], before))
            if right[x] >= 0:
                colour[right[x]] = before
            right[x] = below
            below, x = x, up[x]
        colour[below] = end
        self._splay(cur)
        return found


def runs_of(symbols: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` symbols or more, by start, then period."""
    tree = LastEnds()
    ends: dict[tuple[int, int], int] = {}
    for i, symbol in enumerate(symbols):
        for longest, before in tree.append(symbol):
            period = i - before
            if longest >= period:
                ends[i - longest - period + 1, period] = i
    return sorted((s, i - s + 1, q) for (s, q), i in ends.items() if i - s + 1 >= least)


def stretches(symbols: np.ndarray, owner: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the stretches that may hold runs: what strings of ``least // 2`` symbols cover
    that occur twice or more in one text (``owner``: each symbol's text, ascending; symbols below 2**31)."""
    size = least // 2
    n = len(symbols) - size + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    many = len(symbols) + 1
    # Numbers of strings of 1, 2, 4, ... symbols; overlapping halves make up any size.
    code, span = pd.factorize(symbols)[0].astype(np.int64), 1
    while span < size:
        step = min(span, size - span)
        code = pd.factorize(code[: len(code) - step] * many + code[step:])[0].astype(np.int64)
        span += step
    first = np.flatnonzero(owner[:n] == owner[size - 1 :])
    key = pd.factorize(code[first] * (int(owner[-1]) + 1) + owner[first])[0]
    first = first[np.bincount(key, minlength=1)[key] > 1]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, (np.diff(first) > size) | (owner[first[1:]] != owner[first[:-1]]))
    begin = np.flatnonzero(new)
    return first[begin], first[np.append(begin[1:], len(first)) - 1] + size


def _found(some: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """Each text's runs."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in some]
    long = [i for i, words in enumerate(some) if len(words) >= least]
    sizes = np.array([len(some[i]) for i in long], np.int64)
    total = int(sizes.sum())
    numbers: dict[bytes, int] = {}
    place = count()
    symbols = np.fromiter((n for i in long for n in map(numbers.setdefault, some[i], place)), np.int64, total)
    owner = np.repeat(np.arange(len(long)), sizes)
    begin = np.cumsum(sizes) - sizes
    for a, b in zip(*(x.tolist() for x in stretches(symbols, owner, least))):
        if b - a >= least:
            k = int(owner[a])
            offset = a - int(begin[k])
            out[long[k]] += [(s + offset, n, q) for s, n, q in runs_of(symbols[a:b].tolist(), least)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by single spaces."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period: in words, by start, then period), collapsed (the text's words
    without what runs repeat, joined by single spaces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for a, b in chunks(sizes, sizes, BATCH):
                some = [t.split() for t in batch.column(1).slice(a, b - a).cast(pa.binary()).to_pylist()]
                found = _found(some, least)
                runs = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array([r[k] for own in found for r in own], pa.int64()) for k in range(3)], fields=list(_RUN)
                    ),
                )
                left = pa.array([collapsed(w, r) for w, r in zip(some, found)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), runs, left], ["doc_id", "runs", "collapsed"])

    return texts(docs).mapInArrow(
        run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )


def with_loops(docs: DataFrame, every: int = 10) -> DataFrame:
    """doc_id, text: of one in ``every`` texts, chosen by crc32 of the id, the words from one on repeat
    periodically, three times or more, to the text's end; a text with a null id stays."""
    rows = texts(docs).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.filter(F.split("text", WHITE), lambda w: w != "")
    chosen = rows.withColumn("words", F.when(F.col("h") % every == 0, words))
    n, g = F.size("words"), F.floor(F.col("h") / every)
    drawn = chosen.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))

    def word(i: Column) -> Column:
        k = F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
        return F.get("words", k.cast("int"))

    looped = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return drawn.select("doc_id", F.when(F.col("a").isNotNull(), looped).otherwise(F.col("text")).alias("text"))
