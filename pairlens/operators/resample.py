"""Bootstrap intervals and sign-flip tests with md5 draws.

A draw depends only on the seed, the group, the unit and the resample number, so
results do not change with partitioning or after a lost task. One md5 gives several
draws: four 32-bit uniforms, or 128 signs. Tasks form the sums of all resamples from
blocks of units by array operations; one number per (group, resample) and task travels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import materialize, spread
from .ranking import null_safe_join, position_in_group

try:  # on inputs as short as these several times as fast as hashlib's, with the same digests
    from _md5 import md5
except ImportError:
    from hashlib import md5

_SIGNS_PER_DIGEST = 128
_UNIFORMS_PER_DIGEST = 4
# Cumulative probabilities of a Poisson variable with mean 1, up to where 32 bits end.
_POISSON_CDF = [
    sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(11)
]
_TIE = 1e-12


# Where 32-bit draws step up to the next Poisson count.
_POISSON_STEPS = [math.ceil(p * 2**32) for p in _POISSON_CDF if p * 2**32 <= 2**32 - 1]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_SINES = [np.array(int(abs(math.sin(i + 1)) * 2**32), np.uint32) for i in range(64)]
_MD5_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_MD5_LEFT = [np.array(_MD5_TURNS[i // 16][i % 4], np.uint32) for i in range(64)]
_MD5_RIGHT = [np.array(32 - _MD5_TURNS[i // 16][i % 4], np.uint32) for i in range(64)]
_MD5_WORDS = [(0, 1), (1, 5), (5, 3), (0, 7)]  # round: first message word, step
_MD5_MOST = 55  # bytes that one block of md5 holds
_FEW = 8000  # so many digests are no slower in the library
_LANES = 40_000  # digests that are worked on at a time; their six arrays fit a core's cache
# the eight signs that a byte holds
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0
_PART = 1000  # resamples whose sums travel as one array
_TILE = 1024  # resamples whose weights are read and multiplied at a time, for the same reason


def _words(some: list[bytes], at: int = 0) -> np.ndarray:
    """The 16 little-endian words of a block that holds each string at byte ``at``, by word."""
    held = np.array([b"\0" * at + s for s in some], dtype="S64")
    return np.ascontiguousarray(held.view("<u4").reshape(-1, 16).T)


@lru_cache(64)
def _ends(low: int, high: int, size: int) -> np.ndarray:
    """The words of the ends of messages for blocks ``low`` to ``high`` - 1, after keys of ``size`` bytes."""
    tails = _words([b"|%d\x80" % b for b in range(low, high)], size)
    tails[14] = 8 * (size + len(b"|%d" % low))
    return tails


def _alike(word: np.ndarray) -> np.ndarray:
    """One value in place of equal ones."""
    return word[:1] if (word == word[0]).all() else word


def _sum(word: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Two single 32-bit values added, as an array without axes, which goes through a whole block fastest."""
    return np.array((word.item() + other.item()) % 2**32, np.uint32)


def _md5_blocks(keys: np.ndarray, tails: np.ndarray) -> list[np.ndarray]:
    """Digests, as four 32-bit words, of messages of one block: the words of a key with those of a tail in its gaps.

    Steps before the first word that differs between tails are made once for each key. Passes over the
    arrays are all the time there is, so each writes in place and takes its constant as an array.
    """
    shape = (keys.shape[1], tails.shape[1])
    words = [_alike(k)[:, None] | _alike(t)[None, :] for k, t in zip(keys, tails)]
    order = [words[(_MD5_WORDS[i // 16][0] + _MD5_WORDS[i // 16][1] * i) % 16] for i in range(64)]
    # what a step adds: a word with the step's constant, if that needs no array of its own
    plus = [w if w.shape == shape else w + s if w.size > 1 else _sum(w, s) for w, s in zip(order, _MD5_SINES)]
    first = next((i for i in range(16) if words[i].shape[1] > 1), 15)
    a, b, c, d = (np.full((1, 1), v, np.uint32) for v in _MD5_START)
    for i in range(first):
        f = (((c ^ d) & b) ^ d) + a + order[i] + _MD5_SINES[i]
        a, b, c, d = d, b + (f << _MD5_LEFT[i] | f >> _MD5_RIGHT[i]), b, c
    a, b, c, d = (np.array(np.broadcast_to(v, shape)) for v in (a, b, c, d))
    f, rest = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(first, 64):
        if i < 16:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(f, a, f)
        np.add(f, plus[i], f)
        if plus[i] is order[i]:
            np.add(f, _MD5_SINES[i], f)
        np.right_shift(f, _MD5_RIGHT[i], rest)
        np.left_shift(f, _MD5_LEFT[i], f)
        np.bitwise_or(f, rest, f)
        np.add(f, b, a)
        a, b, c, d = d, a, b, c
    return [np.add(v, np.uint32(s), v) for v, s in zip((a, b, c, d), _MD5_START)]


def digests(keys: list[str], n: int) -> np.ndarray:
    """md5 of ``key|block`` for blocks 0 to n - 1: a row of 16 * n bytes for each key.

    Strings of one length have their parts at the same bytes, so many digests are worked out side by
    side; messages longer than a block of md5, and few of one length, go through the library one by one.
    """
    own = [k.encode() for k in keys]
    out = np.empty((len(keys), n, 4), "<u4")
    sized: dict[int, list[int]] = {}
    for i, k in enumerate(own):
        sized.setdefault(len(k), []).append(i)
    low = 0
    while low < n:
        high = min(n, 10 ** len(str(low)))
        ends = [b"|%d" % b for b in range(low, high)]
        for size, rows in sized.items():
            if size + len(ends[0]) > _MD5_MOST or len(rows) * (high - low) < _FEW:
                for i in rows:
                    held = b"".join([md5(own[i] + e).digest() for e in ends])
                    out[i, low:high] = np.frombuffer(held, "<u4").reshape(-1, 4)
                continue
            tails = _ends(low, high, size)
            wide = max(1, _LANES // (high - low))
            for at in range(0, len(rows), wide):
                some = rows[at : at + wide]
                heads = _words([own[i] for i in some])
                for b in range(low, high, _LANES):
                    z = min(high, b + _LANES)
                    for j, word in enumerate(_md5_blocks(heads, tails[:, b - low : z - low])):
                        out[:, b:z, j][some] = word
        low = high
    return out.view(np.uint8).reshape(len(keys), -1)


def poisson_counts(draws: np.ndarray) -> np.ndarray:
    """The Poisson(1) count of each 32-bit draw: the steps it has reached, the rare high ones looked up."""
    out, reached = np.zeros(draws.shape, np.uint8), np.empty(draws.shape, bool)
    for step in _POISSON_STEPS[:4]:
        np.greater_equal(draws, np.uint32(step), reached)
        out += reached.view(np.uint8)
    np.greater_equal(draws, np.uint32(_POISSON_STEPS[4]), reached)
    high = np.flatnonzero(reached)
    out.reshape(-1)[high] = np.searchsorted(np.array(_POISSON_STEPS, np.uint32), draws.reshape(-1)[high], side="right")
    return out.astype(float)


def _digest(seed: int, by: Sequence[str], unit: str, block: Column) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*by, unit)]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts, block.cast("string")))


def uniform(digest: Column, slot: Column) -> Column:
    """The slot-th 32-bit part of a hex digest as a number in [0, 1)."""
    part = F.substring(digest, slot * 8 + 1, F.lit(8))
    return F.conv(part, 16, 10).cast("double") / F.lit(float(2**32))


def _exploded(
    df: DataFrame, by: Sequence[str], unit: str, value: str, n: int, per_digest: int, seed: int
) -> DataFrame:
    """(by, x, draw, digest, place): each unit once per resample; the digest is computed once
    per block of resamples."""
    blocks = (n + per_digest - 1) // per_digest
    units = df.where(F.col(value).isNotNull()).select(
        *by, unit, F.col(value).cast("double").alias("__x")
    )
    rows = spread(units, unit).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block")
    )
    rows = rows.withColumn("__digest", _digest(seed, by, unit, F.col("__block")))
    last = F.least(F.lit(per_digest), F.lit(n) - F.col("__block") * per_digest) - 1
    rows = rows.select(
        *by, "__x", "__block", "__digest", F.explode(F.sequence(F.lit(0), last)).alias("__place")
    )
    return rows.withColumn("__draw", F.col("__block") * per_digest + F.col("__place"))


def _group_ids(batch: pa.RecordBatch, k: int, groups: dict[tuple, int]) -> np.ndarray:
    """The number in ``groups`` of each row's first ``k`` columns; new groups are added."""
    code = np.zeros(batch.num_rows, np.int64)
    for i in range(k):
        column = batch.column(i).dictionary_encode("encode")
        code = code * len(column.dictionary) + column.indices.to_numpy()
        _, code = np.unique(code, return_inverse=True)
    _, first, like = np.unique(code, return_index=True, return_inverse=True)
    named = batch.select(range(k)).take(pa.array(first))
    met = list(zip(*(named.column(i).to_pylist() for i in range(k)))) if k else [()] * len(first)
    return np.array([groups.setdefault(g, len(groups)) for g in met], int)[like]


def _drawn_sums(
    df: DataFrame, by: Sequence[str], unit: str, value: str, n: int, seed: int, signs: bool, common: Sequence[str] = (),
    measures: Sequence[str] = (),
) -> DataFrame:
    """(by, __draw, __sum, __weight): sums of weight times value and of weights per resample.

    A task keeps one row of sums per group and multiplies blocks of units with their
    weights, Poisson counts or signs read from the digests, so what leaves a task is
    ``n`` numbers per group, however many units it has met. Groups that differ in the
    ``common`` columns only (several measures of one unit) get the same weights, drawn once.
    With ``measures`` a row holds all measures of a unit: ``value`` is an array with an entry for
    each name, which ``by`` and ``common`` call ``metric``.
    """
    if measures and not ("metric" in by and "metric" in common):
        raise ValueError("measures of one row share their draws: by and common must hold metric")
    own = [c for c in by if not (measures and c == "metric")]
    names = [f"__b{i}" for i in range(len(own))]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*(b for b in own if b not in common), unit)]
    values = F.col(value).cast("array<double>") if measures else F.array(F.col(value).cast("double"))
    units = df.where(F.exists(values, lambda x: x.isNotNull())).select(
        *[F.col(c).alias(m) for c, m in zip(own, names)],
        F.concat_ws("|", F.lit(str(seed)), *parts).alias("__key"),
        values.alias("__x"),
    )
    per_digest = _SIGNS_PER_DIGEST if signs else _UNIFORMS_PER_DIGEST
    blocks = (n + per_digest - 1) // per_digest
    some = 1024 if blocks < 200 else 128  # units at a time: enough digests to work side by side, few enough to hold
    k, m = len(own), len(measures) or 1

    def weights(drawn: np.ndarray, low: int, high: int) -> np.ndarray:
        if signs:
            return _SIGNS.take(drawn[:, low // 8 : -(-high // 8)], axis=0).reshape(len(drawn), -1)[:, : high - low]
        return poisson_counts(drawn.view(">u4")[:, low:high].astype(np.uint32))

    def run(batches):
        groups: dict[tuple, int] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}  # by group and measure
        for batch in batches:
            at = _group_ids(batch, k, groups)
            keys, x = batch.column(k).dictionary_encode(), batch.column(k + 1).flatten()
            here = x.is_valid().to_numpy(zero_copy_only=False).reshape(-1, m)
            x = x.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, m)
            place, units = keys.indices.to_numpy(), keys.dictionary.to_pylist()
            for start in range(0, len(units), some):
                drawn = digests(units[start : start + some], blocks)
                rows = np.flatnonzero((place >= start) & (place < start + some))
                met, row = np.unique(at[rows], return_inverse=True)
                cell = row * len(drawn) + place[rows] - start
                held = np.zeros((2, len(met) * len(drawn), m))
                np.add.at(held[0], cell, x[rows])
                np.add.at(held[1], cell, here[rows])
                held = held.reshape(2, len(met), -1, m).swapaxes(2, 3).reshape(2, len(met) * m, -1)
                full = np.flatnonzero(held[1].any(axis=1))  # a group has a measure once a unit has it
                held = np.ascontiguousarray(held[:, full])
                # groups of the same units share their weights' sums
                alike, like = np.unique(held[1], axis=0, return_inverse=True)
                totals, weighed = np.empty((len(full), n)), np.empty((len(alike), n))
                for low in range(0, n, _TILE):
                    high = min(n, low + _TILE)
                    w = weights(drawn, low, high)
                    totals[:, low:high], weighed[:, low:high] = held[0] @ w, alike @ w
                for i, total, j in zip(full.tolist(), totals, like.reshape(-1)):
                    g = (int(met[i // m]), i % m)
                    if g not in sums:
                        sums[g] = np.zeros((2, n))
                    sums[g][0] += total
                    sums[g][1] += weighed[j]
        found = list(groups)
        named = [(*found[g], measures[j]) if measures else found[g] for g, j in sums]
        for low in range(0, n, _PART):
            yield _vectors(named, [v[:, low : low + _PART] for v in sums.values()], low)

    def add(batches):
        held: dict[tuple, np.ndarray] = {}
        z = len(names)
        for batch in batches:
            values = [np.asarray(batch.column(z + 1 + j).flatten()) for j in (0, 1)]
            ends = batch.column(z + 1).offsets.to_numpy()
            ends = ends - ends[0]
            named = zip(*(batch.column(i).to_pylist() for i in range(z + 1)))
            for at, first, last in zip(named, ends, ends[1:]):
                part = np.stack([v[first:last] for v in values])
                held[at] = held[at] + part if at in held else part
        for at, part in held.items():
            yield _vectors([at[:z]], [part], at[z])

    def _vectors(named: list[tuple], parts: list[np.ndarray], low: int) -> pa.RecordBatch:
        columns = [pa.array([g[i] for g in named], types[i]) for i in range(len(names))]
        columns.append(pa.array([low] * len(named), pa.int32()))
        columns += [pa.array([v[j] for v in parts], pa.list_(pa.float64())) for j in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, [*names, "__low", "s", "w"])

    # keys of one length lie together, so that their digests are worked out side by side
    rows = spread(units, "__key").sortWithinPartitions(F.length("__key"), "__key")
    fields = [T.StructField(c, units.schema[c].dataType) for c in names]
    if measures:
        own, names = [*own, "metric"], [*names, "__metric"]
        fields.append(T.StructField("__metric", T.StringType()))
    types = [to_arrow_type(f.dataType) for f in fields]
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [*fields, T.StructField("__low", T.IntegerType()), T.StructField("s", doubles), T.StructField("w", doubles)]
    )
    rows = rows.mapInArrow(run, schema)
    # the tasks' sums are added as arrays; as rows they would be tasks x groups x n
    rows = spread(rows, *names, "__low").mapInArrow(add, schema)
    each = rows.select(*names, "__low", F.posexplode(F.arrays_zip("s", "w")).alias("__at", "z"))
    return (
        each.groupBy(*names, (F.col("__low") + F.col("__at")).alias("__draw"))
        .agg(F.sum("z.s").alias("__sum"), F.sum("z.w").alias("__weight"))
        .select(*[F.col(dict(zip(own, names))[c]).alias(c) for c in by], "__draw", "__sum", "__weight")
    )


def _observed(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean")
    )


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two tables with one row per group; without groups both have one row."""
    if by:
        return null_safe_join(left, right, list(by))
    one = F.lit(1).alias("__one")
    return left.select("*", one).join(right.select("*", one), "__one").drop("__one")


def bootstrap_ci(
    df: DataFrame,
    by: Sequence[str],
    unit: str,
    value: str,
    n_resamples: int = 5000,
    ci: float = 95.0,
    seed: int = 13,
    method: str = "poisson",
    common: Sequence[str] = (),
    measures: Sequence[str] = (),
    observed: DataFrame | None = None,
) -> DataFrame:
    """Percentile interval of the mean per group: ``n_rows, mean, ci_low, ci_high``.

    ``poisson`` weighs each unit with an independent Poisson(1) count per resample, which
    approximates drawing with replacement. ``multinomial`` draws with replacement: a seeded tree of
    binomial draws hands each block of units its number of the n draws, then each unit its count.
    ``exact`` draws with replacement too, as n positions per resample that meet the units by a
    join; it is for few draws that SQL can follow. ``unit`` must tell the rows of a group apart. Groups that differ in
    ``common`` columns only share their Poisson counts. ``measures`` names the entries of ``value`` as
    in :func:`_drawn_sums`; ``observed`` (by, n, mean) holds the groups' counts and means, if they are known.
    """
    if measures and (method != "poisson" or observed is None):
        raise ValueError("measures need poisson draws and the groups' counts and means")
    alpha = (100.0 - ci) / 200.0
    if method == "poisson":
        sums = _drawn_sums(df, by, unit, value, n_resamples, seed, False, common, measures)
        means = sums.withColumn("__mean", F.try_divide("__sum", "__weight"))
    elif method == "multinomial":
        if common:
            raise ValueError("multinomial draws can't be shared by groups")
        sums = multinomial_sums(df, by, unit, value, n_resamples, seed)
        means = sums.withColumn("__mean", F.col("__sum") / F.col("__weight"))
    elif method == "exact":
        means = _exact_means(df, by, unit, value, n_resamples, seed)
    else:
        raise ValueError(f"unknown method {method!r}")
    limits = means.groupBy(*by).agg(
        F.percentile("__mean", F.lit(alpha)).alias("ci_low"),
        F.percentile("__mean", F.lit(1.0 - alpha)).alias("ci_high"),
    )
    if observed is None:
        observed = _observed(df, by, value)
    return _joined(observed.withColumnRenamed("n", "n_rows"), limits, by)


_BLOCK_UNITS = 256


def _generator(*parts: object) -> np.random.Generator:
    """A generator that depends on the parts only."""
    digest = md5("|".join(map(str, parts)).encode()).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest, "little")))


def split_draws(draws: np.ndarray, path: Sequence[tuple[int, int, bool]], name: str) -> np.ndarray:
    """How many of the draws each resample hands to a block: ``path`` has for each level of the tree
    the units of the node and of its left half, and whether the block lies on the right. Blocks below
    one node make the same draw there, so what one half does not get, the other does."""
    place = 0
    for size, left, right in path:
        taken = _generator(name, "node", place).binomial(draws, left / size)
        draws = draws - taken if right else taken
        place = 2 * place + 1 + right
    return draws


def multinomial_sums(df: DataFrame, by: Sequence[str], unit: str, value: str, n: int, seed: int) -> DataFrame:
    """(by, __draw, __sum, __weight) of ``n`` resamples that draw as many units as the group has, with replacement.

    Units lie in blocks by the leading bits of a digest, about 256 to a block. The halves of these
    bits make a binary tree, whose node sizes come from the blocks' sizes by one aggregation. A task solves
    whole blocks and keeps one row of sums per group. Nothing depends on partitions or on the order of
    rows; equal digests are ordered by unit and value.
    """
    keys = [f"__b{i}" for i in range(len(by))]
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    rows = df.where(F.col(value).isNotNull()).select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)],
        F.concat_ws("|", F.lit(str(seed)), *named).alias("__name"),
        F.col(unit).cast("string").alias("__unit"),
        F.col(value).cast("double").alias("__x"),
    )
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce("__unit", F.lit(""))))
    rows = rows.withColumn("__digest", digest)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    # Blocks of a group: 2 ** bits, at most 2 ** 32.
    bits = F.least(F.lit(32), F.greatest(F.lit(0), F.ceil(F.log2(F.col("__n") / _BLOCK_UNITS)))).cast("int")
    sizes = sizes.select(*keys, "__n", bits.alias("__bits"))
    lead = F.conv(F.substring("__digest", 1, 8), 16, 10).cast("bigint")
    placed = _joined(rows, sizes, keys).withColumn(
        "__block", F.floor(lead / F.pow(F.lit(2.0), 32 - F.col("__bits")))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__digest", "__unit", "__x"))), lambda r: r["__x"])
    blocks = placed.groupBy(*keys, "__name", "__n", "__bits", "__block").agg(ordered.alias("__xs"))
    blocks = materialize(blocks, "blocks")

    # A node of level l holds the blocks that share their first l bits.
    def prefix(level: Column) -> Column:
        return F.floor(F.col("__block") / F.pow(F.lit(2.0), F.col("__bits") - level))

    held = blocks.select(*keys, "__block", "__bits", F.size("__xs").alias("__size"), F.explode(F.sequence(F.lit(0), F.col("__bits"))).alias("__level"))
    nodes = held.groupBy(*keys, "__level", prefix(F.col("__level")).alias("__node")).agg(F.sum("__size").alias("__units"))
    nodes = materialize(nodes, "nodes")
    steps = held.where(F.col("__level") < F.col("__bits")).select(
        *keys, "__block", "__level", prefix(F.col("__level")).alias("__node"), (prefix(F.col("__level") + 1) % 2 == 1).alias("right")
    )
    above = nodes.select(*keys, "__level", "__node", F.col("__units").alias("size"))
    lefts = nodes.where("__level > 0 and __node % 2 = 0").select(
        *keys, (F.col("__level") - 1).alias("__level"), F.floor(F.col("__node") / 2).alias("__node"), F.col("__units").alias("left")
    )
    at = [*keys, "__level", "__node"]
    steps = null_safe_join(null_safe_join(steps, above, at), lefts, at)
    path = steps.groupBy(*keys, "__block").agg(
        F.array_sort(F.collect_list(F.struct("__level", "size", F.coalesce("left", F.lit(0)).alias("left"), "right"))).alias("__path")
    )
    solved = null_safe_join(blocks, path, [*keys, "__block"]).select(*keys, "__name", "__n", "__block", "__xs", "__path")
    k = len(by)

    def run(batches):
        groups: dict[tuple, int] = {}
        sums: list[np.ndarray] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                name, size, block, xs, levels = row[k:]
                g = groups.setdefault(row[:k], len(groups))
                if g == len(sums):
                    sums.append(np.zeros((2, n)))
                draws = split_draws(np.full(n, size, np.int64), [(s["size"], s["left"], s["right"]) for s in levels or ()], name)
                x = np.asarray(xs, float)
                for start in range(0, n, 1000):  # a block's counts, a thousand resamples at a time
                    part = draws[start : start + 1000]
                    counts = _generator(name, "block", block, start).multinomial(part, np.full(len(x), 1.0 / len(x)))
                    sums[g][0, start : start + 1000] += counts @ x
                    sums[g][1, start : start + 1000] += counts.sum(axis=1)
        columns = [pa.array([g[i] for g in groups], types[i]) for i in range(k)]
        columns += [pa.array([v[j] for v in sums], pa.list_(pa.float64())) for j in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, [*keys, "s", "w"])

    fields = [T.StructField(m, solved.schema[m].dataType) for m in keys]
    types = [to_arrow_type(f.dataType) for f in fields]
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([*fields, T.StructField("s", doubles), T.StructField("w", doubles)])
    each = spread(solved, *keys, "__block").mapInArrow(run, schema).select(*keys, F.posexplode(F.arrays_zip("s", "w")).alias("__draw", "z"))
    return (
        each.groupBy(*keys, "__draw")
        .agg(F.sum("z.s").alias("__sum"), F.sum("z.w").alias("__weight"))
        .select(*[F.col(m).alias(c) for c, m in zip(by, keys)], "__draw", "__sum", "__weight")
    )


def _exact_means(
    df: DataFrame, by: Sequence[str], unit: str, value: str, n_resamples: int, seed: int
) -> DataFrame:
    """Mean per resample with n draws each: every unit draws one position per resample,
    equal draws are counted, and positions meet values by an equi join."""
    from .ranking import hash_bucket

    rows = df.where(F.col(value).isNotNull()).select(
        *by, unit, F.col(value).cast("double").alias("__x")
    )
    block = hash_bucket(F.col(unit))
    placed = position_in_group(
        rows.withColumn("__order", F.md5(F.col(unit).cast("string"))),
        by, ["__order", unit], block, "__at",
    ).drop("__order")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__size"))
    asked = _exploded(
        null_safe_join(placed, sizes, list(by)) if by else placed.withColumn("__size", sizes.scalar()),
        [*by, "__size"], unit, "__x", n_resamples, _UNIFORMS_PER_DIGEST, seed,
    )
    u = uniform(F.col("__digest"), F.col("__place"))
    draws = (
        asked.withColumn("__at", F.floor(u * F.col("__size")))
        .groupBy(*by, "__at", "__draw")
        .agg(F.count("*").alias("__times"))
    )
    values = placed.select(*by, F.col("__at"), "__x")
    met = null_safe_join(draws, values, [*by, "__at"], "inner")
    return met.groupBy(*by, "__draw").agg(
        (F.sum(F.col("__times") * F.col("__x")) / F.sum("__times")).alias("__mean")
    )


def bootstrap_summary(
    df: DataFrame, by: Sequence[str], unit: str, value: str, **options
) -> DataFrame:
    """:func:`bootstrap_ci` with columns named after the value."""
    out = bootstrap_ci(df, by, unit, value, **options)
    return out.withColumnsRenamed({c: f"{value}_{c}" for c in ("mean", "ci_low", "ci_high")})


def sign_flip_p(
    df: DataFrame,
    by: Sequence[str],
    unit: str,
    value: str,
    n_permutations: int = 10_000,
    seed: int = 42,
    correction: bool = True,
    side: str = "two",
    common: Sequence[str] = (),
    measures: Sequence[str] = (),
    observed: DataFrame | None = None,
) -> DataFrame:
    """Sign-flip test of mean 0 per group: ``n_items, mean, p_value``.

    ``correction`` counts the observed data as one more permutation. ``side='greater'``
    is one-sided. Ties within 1e-12 count as reached, so that summation order does not
    decide them. Groups that differ in ``common`` columns only share their signs. ``measures`` and
    ``observed`` are as in :func:`bootstrap_ci`.
    """
    if measures and observed is None:
        raise ValueError("measures need the groups' counts and means")
    sums = _drawn_sums(df, by, unit, value, n_permutations, seed, True, common, measures)
    if observed is None:
        observed = _observed(df, by, value)
    met = _joined(sums, observed.withColumnRenamed("n", "n_items"), by).withColumn("__mean", F.col("__sum") / F.col("n_items"))
    if side == "greater":
        reached = F.col("__mean") >= F.col("mean") - _TIE
    else:
        reached = F.abs("__mean") >= F.abs("mean") - _TIE
    exceed = F.count_if(reached)
    p = (
        (exceed + 1) / F.lit(n_permutations + 1)
        if correction
        else exceed / F.lit(n_permutations)
    )
    return met.groupBy(*by, "n_items", "mean").agg(p.alias("p_value"))
