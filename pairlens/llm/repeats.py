"""Repeated byte strings across a corpus: an enhanced suffix array over anchored suffixes.

A repeat is a string of ``LEAST`` bytes that starts at two places, in one document or
two. Sorting every suffix of a large corpus is out of reach, so suffixes are sorted where
repeats must show: each window of ``LEAST`` bytes names as its anchor the leftmost of its
``GRAM``-byte strings with the least hash. That choice depends on the window's bytes alone,
so equal windows have equal anchors at equal offsets, and all occurrences of a repeat
meet at an anchor with the same gram.

1. Each anchor is kept with its context, the bytes of all windows that name it (as a 128-bit
   keyed hash). Grams that occur once are dropped. Equal contexts of a gram are one leaf with
   its number of copies; a leaf of several copies is a repeat as it stands.
2. Leaves of a gram with several contexts are keyed on both sides of the anchor: for each
   ``b`` in steps of ``STEP``, by the hash of the ``b`` bytes before the anchor and the
   ``LEAST - STEP + 1 - b`` bytes from it on. Two leaves that share a window share a key, and what
   decides is left: the bytes before the key's string, backwards, and those after it.
3. The keyed suffixes are sorted by sampled splitters, so one key may lie in many ranges. In
   each range a stack scan of common-prefix lengths gives each key's interval tree; in each
   interval the members are sorted by their left extensions, and members that agree on the left
   but not further on either side (the left extensions are diverse, and not all members lie in one
   child) are a maximal repeat, reported with all its occurrences.
4. Intervals of a key that may reach over a range's edge: members that meet others in their range are
   repeats; those alone in it stay open and are counted by (interval, left extension) in an
   aggregation, one row for each range that has others.

So no bucket is gathered in one task, and there is one way for buckets of every size. Contexts
end with the windows of their anchor, so a repeat longer than a context is reported in overlapping
pieces; their union is the same. ``maximal_repeats`` deals whole keys to tasks instead, as its result
lists each group.

Nulls: a null text is the empty text; a row with a null ``doc_id`` is searched neither for
repeats nor as their other place, and keeps its text. Rows that share a ``doc_id`` are told apart
by a hash of their texts. An empty table gives an empty result. Other columns pass through
``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, mix, slices, texts

LEAST, GRAM = 200, 48
REACH = LEAST - GRAM  # the anchor's largest offset in a window
STEP = 8
SHARED = LEAST - STEP + 1  # the bytes of a key's string
PIECE = 1 << 18
HELD = 1 << 22  # bytes of text that a task has at a time, however many a batch brings
_PLACE = np.uint64((1 << 21) - 1)


class Rolling:
    """64-bit hashes of many slices of one array of small numbers.

    Prefix sums of value times a power of an odd base, modulo 2**64; a slice's
    difference is moved to the base's power 0 by the inverse power. For grams only, which are
    far too short for the strings that such hashes confuse; equal hashes only put grams together.
    """

    BASE = 0x9E3779B97F4A7C15
    _pow: np.ndarray | None = None
    _inv: np.ndarray | None = None

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls._pow is None or len(cls._pow) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            with np.errstate(over="ignore"):
                up = np.full(size, cls.BASE, np.uint64)
                down = np.full(size, pow(cls.BASE, -1, 1 << 64), np.uint64)
                up[0] = down[0] = 1
                cls._pow, cls._inv = np.cumprod(up), np.cumprod(down)
        return cls._pow[:n], cls._inv[:n]

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.inv = self.powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64))


def _pieces(some: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int, int]], np.ndarray]]:
    """Joined bytes of about PIECE in size with (text, offset in it, place, length); long texts
    are cut with an overlap, so that each window lies whole in one piece."""
    cut = []
    for i, t in enumerate(some):
        for at in range(0, max(1, len(t) - LEAST + 1), PIECE):
            cut.append((i, at, t[at : at + PIECE + LEAST - 1]))
    for a, b in chunks(cut, [len(c[2]) for c in cut], PIECE):
        about, place = [], 0
        for i, at, own in cut[a:b]:
            about.append((i, at, place, len(own)))
            place += len(own)
        yield about, np.frombuffer(b"".join(c[2] for c in cut[a:b]), np.uint8)


def _digest(string, key: bytes = b"context") -> bytes:
    return hashlib.blake2b(string, digest_size=16, key=key).digest()


def anchors(some: list[bytes]) -> dict[str, np.ndarray]:
    """text, gram, context (two halves c1, c2), and ``at``: place << 16 | bytes before it << 8 | windows - 1."""
    out: dict[str, list[np.ndarray]] = {"text": [], "gram": [], "c1": [], "c2": [], "at": []}
    for about, data in _pieces(some):
        n_windows, n_grams = len(data) - LEAST + 1, len(data) - GRAM + 1
        if n_windows < 1:
            continue
        spans = Rolling(data)
        places = np.arange(n_grams)
        hashes = spans.hash(places, places + GRAM)
        order = hashes & ~_PLACE | places.astype(np.uint64)
        # Sliding minimum: running minima from both ends of blocks of the window's length.
        width = REACH + 1
        blocks = np.append(order, np.full(-n_grams % width, ~np.uint64(0))).reshape(-1, width)
        up = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(down[:n_windows], up[width - 1 : width - 1 + n_windows])
        owner = np.repeat(np.arange(len(about)), [a[3] for a in about])
        whole = owner[:n_windows] == owner[LEAST - 1 :]
        starts = np.flatnonzero(whole)
        least = least[starts]
        if not len(starts):
            continue
        new = np.append(True, (least[1:] != least[:-1]) | (owner[starts[1:]] != owner[starts[:-1]]))
        first = np.flatnonzero(new)
        lo, hi = starts[first], starts[np.append(first[1:], len(starts)) - 1]
        place = (least[first] & _PLACE).astype(np.int64)
        before = place - lo
        piece = owner[lo]
        text, offset, begin = (np.array([a[k] for a in about], np.int64)[piece] for k in range(3))
        held, size = memoryview(data), LEAST + (hi - lo)
        whole = b"".join([_digest(held[a : a + n]) for a, n in zip(lo.tolist(), size.tolist())])
        context = np.frombuffer(whole, np.uint64).reshape(-1, 2)
        with np.errstate(over="ignore"):
            first_half = mix(context[:, 0] + before.astype(np.uint64))
        out["text"].append(text)
        out["gram"].append(hashes[place].view(np.int64))
        out["c1"].append(first_half.view(np.int64))
        out["c2"].append(context[:, 1].copy().view(np.int64))
        out["at"].append(place - begin + offset << 16 | before << 8 | hi - lo)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _span(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the anchor, first byte and end of its context."""
    place, before, more = at >> 16, at >> 8 & 255, at & 255
    return place, place - before, place - before + more + LEAST


def common_prefix(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common-prefix length of each row of a padded matrix with the row before it (first: 0)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        length = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        out[1:] = np.minimum(length, np.minimum(sizes[1:], sizes[:-1]))
    return out


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(first, last, common prefix) of all intervals of the array with a prefix of ``least`` or
    more: the inner nodes of the suffix tree, by one scan with a stack."""
    out, stack = [], [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        left = i - 1
        while stack and stack[-1][1] > now:
            left, height = stack.pop()
            if height >= least and (height or 0 in lcp[1:]):  # a root only if not all share more
                out.append((left, i - 1, height))
        if now >= 0 and (not stack or stack[-1][1] < now):
            stack.append((left, now))
    return out


def _matrix(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    width = max(1, int(sizes.max()))
    return np.frombuffer(b"".join([v.ljust(width, b"\0") for v in values]), np.uint8).reshape(-1, width), sizes


def _agree(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def maximal_groups(left: list[bytes], right: list[bytes]) -> list[tuple[list[int], int, int]]:
    """Maximal repeats among the members of a key, sorted by ``right``, as (members, bytes shared
    before the key's string, bytes shared after it), ``STEP - 1`` bytes together at least.

    ``left``: what stands before the string, backwards; ``right``: what stands after it. Left
    extensions are shared up to ``STEP - 1`` bytes: further ones belong to another key.
    """
    if len(left) == 2:
        before, after = _agree(left[0], left[1]), _agree(right[0], right[1])
        return [([0, 1], before, after)] if before < STEP and before + after >= STEP - 1 else []
    lefts, left_size = _matrix(left)
    lcp = common_prefix(*_matrix(right))
    ended = np.append(lcp, 0)
    rank = np.empty(len(left), np.int64)
    rank[np.array(sorted(range(len(left)), key=left.__getitem__))] = np.arange(len(left))
    out = []
    for first, last, after in intervals(lcp.tolist(), 0):
        members = np.arange(first, last + 1)
        members = members[np.argsort(rank[members])]
        extension = common_prefix(lefts[members], left_size[members])
        for a, b, before in intervals(extension.tolist(), max(0, STEP - 1 - after)):
            if before >= STEP:
                continue
            own = np.sort(members[a : b + 1])
            # Left extensions are diverse by the interval; so are right ones if not all lie in one child.
            if (np.minimum.reduceat(ended, own + 1)[:-1] == after).any():
                out.append((own.tolist(), before, after))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash that tells rows of one id apart), text."""
    return texts(docs).select("doc_id", F.xxhash64("text").alias("mark"), "text")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, mark and the text's bytes, compressed for the way through a shuffle."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in (part for whole in batches for part in slices(whole, 2, HELD)):
            own = [squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], ["doc_id", "mark", "packed"])

    return _rows(docs).mapInArrow(run, "doc_id long, mark long, packed binary")


def _anchor_table(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2, HELD)):
            some = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found = anchors(some)
            text = found.pop("text")
            arrays = [ids[text], marks[text], *found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["doc_id", "mark", *found])

    return _rows(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, mark long, gram long, c1 long, c2 long, at long")


_LONG, _BYTES = pa.int64(), pa.binary()


def _flushed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def keys_of(own: bytes, before: int, whole: bool) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(b, key, bytes before the key's string backwards, bytes after it) of a context whose anchor
    stands after ``before`` bytes. ``whole``: all bytes after it and one more before it."""
    for b in range(0, REACH + 1, STEP):
        first, end = before - b, before - b + SHARED
        if first >= 0 and end <= len(own):
            rest = own[max(0, first - STEP + (not whole)) : first][::-1]
            yield b, _digest(own[first:end], b"key %d" % b), rest, own[end : None if whole else end + STEP - 1]


_KEYED = "k1 long, k2 long, rest binary, left binary, b long, c1 long, c2 long"


def _keyed(leaves: DataFrame, docs: DataFrame, whole: bool) -> DataFrame:
    """The keyed suffixes of leaves (doc_id, mark, at: one place of each): key, rest (what follows the key's
    string), left, b, leaf; with ``whole`` also the context's bytes and the anchor's place in them."""
    per_doc = leaves.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("at", "c1", "c2")).alias("wanted"))
    fields = [("k1", _LONG), ("k2", _LONG), ("rest", _BYTES), ("left", _BYTES), ("b", _LONG), ("c1", _LONG), ("c2", _LONG)]
    fields += [("own", _BYTES), ("before", _LONG)] if whole else []

    def run(batches):
        def rows():
            expand = zstandard.ZstdDecompressor()
            for batch in (part for whole in batches for part in slices(whole, 0, HELD // 4)):
                for packed, lists in zip(batch.column(0), _lists(batch.column(1), "at", "c1", "c2")):
                    text = expand.decompress(packed.as_buffer())
                    place, first, end = (x.tolist() for x in _span(lists[0]))
                    for p, a, z, c1, c2 in zip(place, first, end, lists[1].tolist(), lists[2].tolist()):
                        own = text[a:z]
                        for b, key, left, rest in keys_of(own, p - a, whole):
                            halves = int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)
                            yield (*halves, rest, left, b, c1, c2, own, p - a) if whole else (*halves, rest, left, b, c1, c2)

        yield from _flushed(rows(), pa.schema(fields))

    joined = _packed(docs).join(per_doc, ["doc_id", "mark"]).select("packed", "wanted")
    return joined.mapInArrow(run, _KEYED + (", own binary, before long" if whole else ""))


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[list]]]:
    """(is the first or last of the range, columns) of each key with several rows, or at an edge."""
    held: list[pa.RecordBatch] = []
    first = True
    for batch in batches:
        k1, k2 = (batch.column(k).to_numpy() for k in (0, 1))
        if not len(k1):
            continue
        cut = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (k1[0], k2[0]):
            yield first, _columns(held)
            first, held = False, []
        ends = np.append(cut[1:], len(k1))
        for a, b in zip(cut[:-1].tolist(), ends[:-1].tolist()):
            if held or first or b - a > 1:
                yield first, _columns([*held, batch.slice(a, b - a)])
            first, held = False, []
        held.append(batch.slice(cut[-1], len(k1) - cut[-1]))
    if held:
        yield True, _columns(held)


def _columns(parts: list[pa.RecordBatch]) -> list[list]:
    return [[v for p in parts for v in p.column(k).to_pylist()] for k in range(parts[0].num_columns)]


def _scan(keyed: DataFrame) -> DataFrame:
    """c1, c2, first, end (from the anchor on) of what repeats; rows with a level are open: members of an
    interval of that depth that are alone in their range, with the key and what they share if they do.
    Members that meet others in their range repeat as they stand; one open row without a leaf tells of them."""
    fields = [(n, _LONG) for n in ("c1", "c2", "first", "end", "k1", "k2", "level")] + [("shared", _BYTES)]

    def run(batches):
        def rows():
            for edge, (k1, k2, rest, left, b, c1, c2) in _by_key(batches):
                if not edge:
                    for members, before, after in maximal_groups(left, rest):
                        for m in members:
                            yield c1[m], c2[m], -b[m] - before, SHARED - b[m] + after, None, None, None, None
                    continue
                for level in range(STEP):
                    alike: dict[bytes, list[int]] = {}
                    for m in range(len(k1)):
                        if len(left[m]) >= STEP - 1 - level and len(rest[m]) >= level:
                            alike.setdefault(left[m][: STEP - 1 - level] + rest[m][:level], []).append(m)
                    for shared, members in alike.items():
                        alone = len(members) == 1
                        for m in members:
                            span = level - STEP + 1 - b[m], SHARED - b[m] + level
                            yield c1[m], c2[m], *span, *((k1[m], k2[m], level, shared) if alone else (None,) * 4)
                        if not alone:
                            yield None, None, None, None, k1[0], k2[0], level, shared

        yield from _flushed(rows(), pa.schema(fields))

    order = ["k1", "k2", "rest", "left"]
    ranges = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "c1 long, c2 long, first long, end long, k1 long, k2 long, level long, shared binary")


def _groups(keyed: DataFrame) -> DataFrame:
    """c1, c2, first, end, repeat (a number of the string) of the members of each maximal repeat."""
    fields = [(n, _LONG) for n in ("c1", "c2", "first", "end", "repeat")]

    def run(batches):
        def rows():
            for _, (_, _, rest, left, b, c1, c2, own, at) in _by_key(batches):
                for members, before, after in maximal_groups(left, rest) if len(left) > 1 else ():
                    m = members[0]
                    first, end = -b[m] - before, SHARED - b[m] + after
                    number = _number(own[m][at[m] + first : at[m] + end])
                    for m in members:
                        yield c1[m], c2[m], first, end, number

        yield from _flushed(rows(), pa.schema(fields))

    order = ["k1", "k2", "rest", "left"]
    ordered = keyed.repartition("k1", "k2").sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "c1 long, c2 long, first long, end long, repeat long")


def _number(string: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "big", signed=True)


def repeats(docs: DataFrame, scratch: Scratch, groups: bool = False) -> DataFrame:
    """doc_id, mark, spans (first, end; with ``groups`` repeat): byte ranges that are covered by repeats.

    With ``groups`` the spans are maximal repeats, one for each occurrence, with a number that
    all occurrences of a string share.
    """
    found = scratch.keep(_anchor_table(docs), "anchors")
    same = (F.min("c1") == F.max("c1")) & (F.min("c2") == F.max("c2"))
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), same.alias("same"))
    # Written first: between two plain tables Spark can split the partition of a frequent gram.
    grams = scratch.keep(grams.where("n > 1").drop("n"), "grams")
    shared = scratch.keep(found.join(grams, "gram").select("doc_id", "mark", "c1", "c2", "at", "same"), "shared")
    scratch.drop("anchors")
    leaves = shared.groupBy("c1", "c2", "same").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "mark", "at")).alias("one"))
    leaves = scratch.keep(leaves.select("c1", "c2", "same", "k", "one.*"), "leaves")
    keyed = scratch.keep(_keyed(leaves.where(~F.col("same")), docs, whole=groups), "keyed")

    before = F.shiftright("at", 8).bitwiseAND(255)
    end = F.col("at").bitwiseAND(255) + LEAST - before
    copies = leaves.where("k > 1").select("c1", "c2", (-before).alias("first"), end.alias("end"))
    if groups:
        hits = _groups(keyed).union(copies.withColumn("repeat", F.col("c1").bitwiseXOR(F.col("c2"))))
        span = F.struct("first", "end", "repeat")
    else:
        scanned = scratch.keep(_scan(keyed), "scanned")
        closed = scanned.where("level is null").select("c1", "c2", "first", "end")
        opened, meet = scanned.where("level is not null"), ["k1", "k2", "level", "shared"]
        again = scratch.keep(opened.groupBy(*meet).agg(F.count("*").alias("c")).where("c > 1").drop("c"), "again")
        alone = opened.where("c1 is not null").join(again, meet)
        hits = closed.union(alone.select("c1", "c2", "first", "end")).union(copies)
        span = F.struct("first", "end")
    per_leaf = scratch.keep(hits.groupBy("c1", "c2").agg(F.collect_set(span).alias("hits")), "hits")
    place = F.shiftright("at", 16)

    def moved(h: Column) -> Column:
        rest = [h["repeat"].alias("repeat")] if groups else []
        return F.struct((place + h["first"]).alias("first"), (place + h["end"]).alias("end"), *rest)

    return shared.join(per_leaf, ["c1", "c2"]).select("doc_id", "mark", F.transform("hits", moved).alias("spans"))


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that ranges cover together; ranges that touch make one run."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.append(True, first[1:] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(first)) - 1
    return first[new], end[last]


def _per_doc(spans: DataFrame) -> DataFrame:
    """The ranges of each document; they are no more than its anchors and windows."""
    return spans.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    per_doc = _per_doc(repeats(docs, Scratch(docs.sparkSession, "repeats")))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1, HELD // 4)):
            expand = zstandard.ZstdDecompressor()
            out = []
            rows = zip(batch.column(0).to_pylist(), batch.column(1), _lists(batch.column(2), "first", "end"))
            for doc_id, packed, (first, end) in rows:
                text = expand.decompress(packed.as_buffer())
                kept, n = _kept(text, first, end)
                removed = len(text) - len(kept)
                out.append((doc_id, len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept))
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    joined = _packed(docs).join(per_doc, ["doc_id", "mark"], "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _lists(column: pa.ListArray, *fields: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The fields of each row's structs as arrays; a null row has none."""
    offsets = column.offsets.to_numpy()
    values = [column.values.field(f).to_numpy(zero_copy_only=False) for f in fields]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield tuple(v[a:b] for v in values)


def _kept(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple[bytes, int]:
    """What stays of a text, and the number of runs that go."""
    if not len(first):
        return text, 0
    first, end = merged(first, end)
    edges = [0, *np.column_stack([first, end]).reshape(-1).tolist(), len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]), len(first)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes cut from the texts; all rows and columns stay.

    Bytes of a character that a cut has split go too. A column ``n_chars`` is brought up to date.
    """
    columns, place = docs.columns, docs.columns.index("text")
    per_doc = _per_doc(repeats(docs, Scratch(docs.sparkSession, "repeats"))).toDF("_doc", "_mark", "_spans")
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.join(per_doc, (F.col("doc_id").cast("long") == F.col("_doc")) & (mark == F.col("_mark")), "left").drop("_doc", "_mark")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, place, HELD)):
            own = []
            for text, (first, end) in zip(batch.column(place).to_pylist(), _lists(batch.column(len(columns)), "first", "end")):
                if len(first) and text is not None:
                    text = _kept(text.encode("utf-8", "surrogatepass"), first, end)[0].decode("utf-8", "ignore")
                own.append(text)
            arrays = [pa.array(own, pa.string()) if i == place else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    out = joined.mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """repeat, doc_id, first, end: each maximal repeat with all its occurrences."""
    found = repeats(docs, Scratch(docs.sparkSession, "repeats"), groups=True)
    return found.select("doc_id", F.inline("spans")).select("repeat", "doc_id", "first", "end").distinct()
