"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct shingles of five words. Its signature has
``SYMBOLS`` MinHash symbols of 16 bits, cut into ``CHUNKS`` chunks. Two signatures that
differ in at most ``RADIUS`` symbols have, by the pigeonhole rule, a chunk with one error
at most; a key for each symbol left out of each chunk enumerates those errors, so every
such pair meets on a key. At a similarity of 0.75 a pair's distance passes ``RADIUS`` with
a chance of 1.23e-4 (binomial tail); pairs that met on a key are compared whatever their distance.
A finer signature of ``FINE`` bytes then drops pairs that agree in
fewer than ``FINE_LEAST`` (chance 5.5e-6 at 0.75), and every link is confirmed on the full
sets.

Links are found in rounds, so that a group of near copies is never expanded into pairs:

1. Documents with equal sets are one class; its smallest ``doc_id`` stands for it.
2. Each document is compared with one leader: of the leaders of its keys (the document
   that meets most others), the one it shares most keys with. Confirmed links give components.
3. On keys that hold several components, documents of small keys (``SMALL`` rows) are
   compared with all of other components, those of large keys with their nearest one.
4. On large keys that still hold several components, all remaining pairs of different
   components are compared, by their sets' ``SKETCH`` least hashes (whole sets,
   if they are no larger; else an estimate that falls below ``SKETCH_LEAST`` at a similarity of 0.75 with a
   chance of 3e-6), and those that may be links in full. Rows of the key's main component are
   never compared with one another, and keys are cut into blocks of ``BLOCK`` rows.

After round 4 every pair that meets on a key, so every one within the radius, was compared or lies in one component.

Nulls: a null text has no words, like the empty one: an empty set, linked with nothing. A
row with a null ``doc_id`` is linked with nothing and has a null component_id; rows that
share a ``doc_id`` are one node. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, even, mix, slice_hashes, texts
from .components import components

SHINGLE, PERCENT = 5, 75
SYMBOLS, CHUNKS, RADIUS = 64, 15, 29
FINE, FINE_LEAST = 256, 161
SKETCH, SKETCH_LEAST = 512, 0.664
SMALL, BLOCK = 16, 2048
BATCH_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MULTIPLIERS = np.random.default_rng(20240229).integers(0, 1 << 63, FINE // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(some: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b" ".join(some).translate(_LOWER) + b" ", np.uint8)
    bounds = np.cumsum([0, *(len(t) + 1 for t in some)])
    space = _SPACE[data]
    change = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = change[::2], change[1::2]
    words, _ = slice_hashes(data, starts, ends)
    first = np.searchsorted(starts, bounds)
    rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE if len(rolled) else 0):
            rolled = rolled * _STEP + words[j : len(words) - SHINGLE + 1 + j]
        rolled = mix(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                yield np.unique(rolled[a : b - SHINGLE + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    whole = whole * _STEP + w
                yield mix(mix(whole))
            else:
                yield np.zeros(0, np.uint64)


def minima(own: np.ndarray, n: int = FINE) -> np.ndarray:
    """``n`` MinHash minima of 32 bits, two from each multiplication."""
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(own), 1024):
            part = (own[k : k + 1024, None] * _MULTIPLIERS[: n // 2]).view(np.uint32)
            np.minimum(least, part.min(axis=0), out=least)
    return least


def _subsets() -> list[list[int]]:
    """The symbols of each key: a chunk without one of its symbols."""
    edges = [round(k * SYMBOLS / CHUNKS) for k in range(CHUNKS + 1)]
    return [[i for i in range(a, b) if i != out] for a, b in zip(edges, edges[1:]) for out in range(a, b)]


SUBSETS = _subsets()


def key_table(coarse: np.ndarray) -> np.ndarray:
    """The keys of signatures (rows): a hash of the symbols, the key's number in its low 6 bits."""
    out = np.empty((len(coarse), len(SUBSETS)), np.uint64)
    with np.errstate(over="ignore"):
        for k, own in enumerate(SUBSETS):
            h = np.full(len(coarse), k + 1, np.uint64)
            for i in own:
                h = h * _STEP + coarse[:, i].astype(np.uint64) + np.uint64(1)
            out[:, k] = mix(h) & ~np.uint64(63) | np.uint64(k)
    return out.view(np.int64)


def coarse_of(least: np.ndarray) -> bytes:
    return (least[:SYMBOLS] * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2").tobytes()


def fine_of(least: np.ndarray) -> bytes:
    return (least * np.uint32(0x85EBCA6B) >> np.uint32(24)).astype(np.uint8).tobytes()


def _each_set(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    some = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
    for a, b in chunks(some, list(map(len, some)), BATCH_BYTES):
        yield from shingle_sets(some[a:b])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set), coarse signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, coarse = [], [], []
            for own in _each_set(batch):
                sizes.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                coarse.append(coarse_of(minima(own, SYMBOLS)) if len(own) else None)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (keys, coarse))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set_key", "coarse"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, coarse binary")


def _sets(docs: DataFrame) -> DataFrame:
    """node, own (the whole set), coarse and fine signatures, sketch (least hashes, upper halves)."""

    def run(batches):
        for batch in batches:
            rows = []
            for own in _each_set(batch):
                least = minima(own)
                rows.append((own.tobytes(), coarse_of(least), fine_of(least), (own[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes()))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in columns)], ["node", "own", "coarse", "fine", "sketch"])

    return docs.mapInArrow(run, "node long, own binary, coarse binary, fine binary, sketch binary")


def _keys(signed: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            coarse = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, SYMBOLS)
            keys = key_table(coarse)
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(nodes)], ["key", "node"])

    return signed.select("node", "coarse").mapInArrow(run, "key long, node long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs ``a``, ``b`` those whose full sets are similar enough.

    The second partner, which many pairs may name, is joined first, while rows are
    narrow; Spark splits its partition if need be.
    """

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    n = F.length("own")
    right = sets.select(F.col("node").alias("b"), F.col("own").alias("y"), n.alias("n_y"))
    left = sets.select(F.col("node").alias("a"), F.col("own").alias("x"), n.alias("n_x"))
    near = (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * PERCENT)
    return pairs.join(right, "b").join(left, "a").where(near).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def may_link(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sets with these sketches may be similar enough."""
    both = len(np.intersect1d(x, y))
    if len(x) < SKETCH and len(y) < SKETCH:
        return 100 * (both + 1) >= PERCENT * (len(x) + len(y) - both - 1)
    least = np.union1d(x, y)[:SKETCH]
    shared = np.count_nonzero(np.isin(least, x, assume_unique=True) & np.isin(least, y, assume_unique=True))
    return shared >= SKETCH_LEAST * len(least)


def _compare(left: dict, right: dict, nearest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of different components that may be alike: places left and right, agreeing bytes."""
    found = []
    for j in range(len(right["node"])):
        other = np.flatnonzero(left["component"] != right["component"][j])
        if not len(other):
            continue
        same = (left["fine"][other] == right["fine"][j]).sum(axis=1)
        close = same >= FINE_LEAST
        other, same = other[close], same[close]
        if nearest and len(other):
            best = int(np.argmax(same))
            other, same = other[best : best + 1], same[best : best + 1]
        found.append((other, np.full(len(other), j), same))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def _block_pairs(rows: DataFrame, sets: DataFrame, nearest: bool) -> DataFrame:
    """a, b, same: pairs of different components on the large keys ``rows`` (key, node, component).

    A key's rows outside its main component stand on the right, in blocks, and meet all
    rows of the key, in blocks. ``nearest``: for each right row its nearest partner only.
    A pair is given by the first key it shares, so once, and only if its sketches allow a link.
    """
    by_component = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    about = by_component.groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")
    ).select(
        "key",
        F.col("top.component").alias("main"),
        F.ceil(F.col("top.n") / BLOCK).alias("main_blocks"),
        F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("rest_blocks"),
    )
    placed = rows.join(about, "key").withColumn("is_main", F.col("component") == F.col("main"))
    h = F.xxhash64("node")
    block = F.when(F.col("is_main"), F.pmod(h, F.col("main_blocks"))).otherwise(F.pmod(h, F.col("rest_blocks")))
    placed = placed.withColumn("block", block.cast("int")).join(
        sets.select("node", "coarse", "fine", "sketch"), "node"
    )
    # A main row meets each block of the rest; a row of the rest stands left in its own
    # block against blocks up to it, and right against all main blocks and blocks from it on.
    last_rest, last_main = F.col("rest_blocks").cast("int") - 1, F.col("main_blocks").cast("int") - 1
    up_to = F.when(F.col("is_main"), last_rest).otherwise(F.col("block"))
    on_left = placed.select(
        "*", F.lit(True).alias("left"), F.col("is_main").alias("against_main"), F.col("block").alias("i"),
        F.explode(F.sequence(F.lit(0), up_to)).alias("j"),
    )
    rest = placed.where(~F.col("is_main"))
    versus_main = rest.select(
        "*", F.lit(False).alias("left"), F.lit(True).alias("against_main"),
        F.explode(F.sequence(F.lit(0), last_main)).alias("i"), F.col("block").alias("j"),
    )
    versus_rest = rest.select(
        "*", F.lit(False).alias("left"), F.lit(False).alias("against_main"),
        F.explode(F.sequence(F.col("block"), last_rest)).alias("i"), F.col("block").alias("j"),
    )
    columns = ["key", "against_main", "i", "j", "left", "node", "component", "coarse", "fine", "sketch"]
    tasks = on_left.select(columns).union(versus_main.select(columns)).union(versus_rest.select(columns))

    def run(table: pa.Table) -> pa.Table:
        is_left = table.column("left").to_numpy()
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        coarse = np.frombuffer(b"".join(table.column("coarse").to_pylist()), "<u2").reshape(-1, SYMBOLS)
        fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
        sketch = np.empty(len(node), object)
        sketch[:] = [np.frombuffer(s, "<u4") for s in table.column("sketch").to_pylist()]
        all_rows = {"node": node, "component": component, "coarse": coarse, "fine": fine, "sketch": sketch}
        left = {k: v[is_left] for k, v in all_rows.items()}
        right = {k: v[~is_left] for k, v in all_rows.items()}
        x, y, same = _compare(left, right, nearest)
        if not nearest and len(x):
            number = int(table.column("key")[0].as_py()) & 63
            first = np.full(len(x), len(SUBSETS))
            for k in range(number, -1, -1):
                first[(left["coarse"][x][:, SUBSETS[k]] == right["coarse"][y][:, SUBSETS[k]]).all(axis=1)] = k
            x, y, same = x[first == number], y[first == number], same[first == number]
        good = np.array([may_link(left["sketch"][i], right["sketch"][j]) for i, j in zip(x, y)], bool)
        x, y, same = x[good], y[good], same[good]
        return pa.table({"a": right["node"][y], "b": left["node"][x], "same": pa.array(same, pa.int64())})

    return tasks.groupBy("key", "against_main", "i", "j").applyInArrow(run, "a long, b long, same long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (smallest id with an equal set)."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed_all = scratch.keep(signatures(docs), "signatures")
    named = signed_all.where("doc_id is not null and n_shingles > 0")
    classes = scratch.keep(named.groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")
    signed = scratch.keep(
        named.join(classes.select("set_key", "node"), "set_key").where("doc_id = node").select("node", "coarse").distinct(),
        "signed",
    )
    keys = _keys(signed)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    meets = scratch.keep(keys.join(shared, "key").select("key", "node", "n"), "meets")
    candidates = meets.select(F.col("node").alias("doc_id")).distinct()
    sets = scratch.keep(_sets(texts(docs).join(candidates, "doc_id", "left_semi")), "sets")

    # Round 1: one leader for each document.
    met = meets.groupBy("node").agg(F.sum("n").alias("met"))
    lead = (
        meets.join(met, "node")
        .groupBy("key")
        .agg(F.max(F.struct("met", (-F.col("node")).alias("least"))).alias("top"))
        .select("key", (-F.col("top.least")).alias("leader"))
    )
    votes = meets.join(lead, "key").where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("node").agg(F.max(F.struct("votes", (-F.col("leader")).alias("least"))).alias("top"))
    tested = scratch.keep(chosen.select(F.col("node").alias("a"), (-F.col("top.least")).alias("b")), "pairs-1")
    links = scratch.keep(confirmed(tested, sets), "links-1")
    labels = scratch.keep(components(links, scratch, "stars-1"), "labels-1")

    def mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """key, node, n, component of the keys that hold several components."""
        labelled = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
        return labelled.join(several.select("key"), "key", "left_semi").select("key", "node", "n", "component")

    def untested(pairs: DataFrame, done: DataFrame) -> DataFrame:
        """Pairs with the smaller node first, without those already compared."""
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        past = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return ordered.join(past, ["a", "b"], "left_anti")

    # Round 2: all pairs of small keys, the nearest partner on large keys.
    open_rows = scratch.keep(mixed(meets, labels), "open-2")
    member = F.struct("component", "node")
    small = open_rows.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list(member).alias("m"))
    small = small.select(F.array_sort("m").alias("m")).distinct()
    one = small.select(F.explode("m").alias("x"), "m")
    small_pairs = one.select("x", F.explode("m").alias("y")).where("x.component < y.component")
    small_pairs = small_pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    large = open_rows.where(F.col("n") > SMALL)
    close = _block_pairs(large.select("key", "node", "component"), sets, nearest=True)
    nearest = close.groupBy("a").agg(F.max(F.struct("same", (-F.col("b")).alias("least"))).alias("top"))
    nearest = nearest.select("a", (-F.col("top.least")).alias("b"))
    second = scratch.keep(untested(small_pairs.union(nearest), tested), "pairs-2")
    links_2 = scratch.keep(confirmed(even(_similar(second, sets)), sets), "links-2")
    links, tested = links.union(links_2), tested.union(second)
    labels = scratch.keep(components(links, scratch, "stars-2"), "labels-2")

    # Round 3: what is left on large keys.
    open_rows = scratch.keep(mixed(large.select("key", "node", "n"), labels), "open-3")
    rest = _block_pairs(open_rows.select("key", "node", "component"), sets, nearest=False)
    third = scratch.keep(untested(rest.select("a", "b"), tested), "pairs-3")
    links = links.union(scratch.keep(confirmed(third, sets), "links-3"))
    labels = scratch.keep(components(links, scratch, "stars-3"), "labels-3")

    return (
        signed_all.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
        .join(classes, "set_key", "left")
        .join(labels, "node", "left")
        .withColumn("component_id", F.coalesce("component", "node", "doc_id"))
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
            F.coalesce("node", "doc_id").alias("class_id"),
        )
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the near duplicates of a smaller doc_id, with all columns."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose fine signatures agree enough to be compared in full."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE) for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= FINE_LEAST))

    left = sets.select(F.col("node").alias("a"), F.col("fine").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("fine").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
