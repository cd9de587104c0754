"""Vector tables: pooling, centring, exact cosine neighbours."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, spread
from .ranking import topk_per_key

_BLOCK = 4096
_CELLS = 1 << 18  # bounds of bins, or visits of blocks, that a task works out at a time
_SENT = 4096  # vectors that a task hands over at a time


def mean_vector(df: DataFrame, vector: str) -> DataFrame:
    """One row: the mean vector, from one mean per position."""
    cells = df.select(F.posexplode(vector).alias("i", "x"))
    means = cells.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.agg(F.transform(ordered, lambda s: s["m"]).alias("mean"))


def mean_pool(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean vector per group of piece vectors."""
    cells = df.select(*by, F.posexplode(vector).alias("i", "x"))
    means = cells.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy(*by).agg(F.transform(ordered, lambda s: s["m"]).alias(vector))


def center_vectors(df: DataFrame, vector: str, name: str = "centered") -> DataFrame:
    """Vectors minus the joint mean of all rows."""
    mean = mean_vector(df, vector).scalar()
    return df.withColumn("__m", mean).withColumn(
        name, F.zip_with(F.col(vector), F.col("__m"), lambda x, m: x.cast("double") - m)
    ).drop("__m")


def _unit(vectors: pd.Series) -> np.ndarray:
    if vectors.isna().any():
        raise ValueError("a vector is null")
    matrix = np.vstack(vectors.to_numpy()).astype(float)
    if not np.isfinite(matrix).all():
        raise ValueError("a vector holds a null or a number that is not finite")
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm > 0, norm, 1.0)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of rows to pivots; a zero row has none (NaN)."""
    if not len(pivots):
        return np.zeros((len(unit), 0))
    out = np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))
    out[~unit.any(axis=1)] = np.nan
    return out


class Bins(NamedTuple):
    """Where references lie: each bin's cell (a pivot's number; one more for zero vectors), the least and
    greatest angle to its pivot, and into how many blocks its rows are dealt."""

    cell: np.ndarray
    least: np.ndarray
    most: np.ndarray
    parts: np.ndarray

    def bounds(self, angles: np.ndarray) -> np.ndarray:
        """The greatest cosine that each bin may hold for queries at these angles to the pivots: the angle between
        query and reference is at least the difference of their angles to a pivot."""
        if not angles.shape[1]:
            return np.zeros((len(angles), len(self.cell)))
        own = np.column_stack([angles, np.zeros(len(angles))])[:, self.cell]
        apart = np.maximum(np.maximum(self.least - own, own - self.most), 0.0)
        out = np.where(self.cell == angles.shape[1], 0.0, np.cos(apart))
        out[np.isnan(angles).any(axis=1)] = 0.0  # a zero vector has cosine 0 with all
        return out


def _pivots(references: DataFrame, key: str, vector: str, n: int) -> np.ndarray:
    """Up to ``n`` different unit vectors, chosen by a hash of the key; none only if all vectors are zero."""
    some = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | (x != 0))
    rows = references.where(some).select(F.col(vector).alias("v"), F.col(key)).orderBy(F.xxhash64(key), key).limit(n).toPandas()
    unit = np.unique(np.round(_unit(rows["v"]), 12), axis=0) if len(rows) else np.zeros((0, 1))
    return unit[unit.any(axis=1)]


def _best(unit_q: np.ndarray, own: np.ndarray, unit_r: np.ndarray, names: np.ndarray, k: int, exclude_self: bool):
    """(row of the query, place of the reference, cosine) of the k best; ``names`` in order."""
    sims = np.round(unit_q @ unit_r.T, 12)
    if exclude_self:
        sims[own[:, None] == names[None, :]] = -np.inf
    top = min(k, sims.shape[1])
    at = np.argpartition(-sims, top - 1, axis=1)[:, :top]
    least = np.take_along_axis(sims, at, axis=1).min(axis=1, keepdims=True)
    tied = (sims >= least).sum(axis=1) > top
    at[tied] = np.argsort(-sims[tied], axis=1, kind="stable")[:, :top]
    rows, flat = np.repeat(np.arange(len(own)), top), at.ravel()
    good = np.isfinite(sims[rows, flat])
    return rows[good], flat[good], sims[rows, flat][good]


def _met(visits: DataFrame, held: DataFrame, k: int, exclude_self: bool, crowd: int) -> DataFrame:
    """(query, reference, cosine): the k best of each visited block. ``visits``: query, v, bin, part.

    A task reads a block's references, then streams the queries that visit it. A block with more
    than ``crowd`` visits is copied, so that its queries spread over tasks.
    """
    block = ["bin", "part"]
    copies = visits.groupBy(*block).agg(F.ceil(F.count("*") / crowd).cast("int").alias("copies"))
    copies = materialize(copies, "visits")
    right = held.join(copies, block).select(
        *block, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(False).alias("asks"), F.col("reference").alias("name"), "v"
    )
    left = visits.join(copies, block).select(
        *block, F.pmod(F.xxhash64("query"), F.col("copies")).cast("int").alias("copy"), F.lit(True).alias("asks"), F.col("query").alias("name"), "v"
    )
    rows = spread(right.union(left), *block, "copy").sortWithinPartitions(*block, "copy", "asks", "name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, names, unit_r = None, [], None, None
        for batch in batches:
            for place, own in batch.groupby([*block, "copy"], sort=False):
                if place != at:
                    at, parts, unit_r = place, [], None
                if not own["asks"].iloc[-1]:
                    parts.append(own)
                    continue
                parts.append(own[~own["asks"]])
                if unit_r is None:
                    refs = pd.concat(parts)
                    names = refs["name"].to_numpy()
                    unit_r = _unit(refs["v"]) if len(refs) else np.zeros((0, 1))
                asked = own[own["asks"]] if len(names) else own[:0]
                for start in range(0, len(asked), 512):
                    chunk = asked.iloc[start : start + 512]
                    who = chunk["name"].to_numpy()
                    i, j, cosine = _best(_unit(chunk["v"]), who, unit_r, names, k, exclude_self)
                    yield pd.DataFrame({"query": who[i], "reference": names[j], "cosine": cosine})

    return rows.mapInPandas(run, "query string, reference string, cosine double")


def _visits(batches: Iterator[pd.DataFrame], bins: Bins, points: np.ndarray, first: bool) -> Iterator[pd.DataFrame]:
    """(query, v, bin, part): the first block of each query, or all others that may hold a neighbour. What is held at a
    time does not grow with the batch, the bins or the blocks, but for one query's list of blocks."""
    step = max(1, _CELLS // max(1, len(bins.cell) if first else int(bins.parts.sum())))
    for batch in (b.iloc[a : a + step] for b in batches for a in range(0, len(b), step)):
        names, v = batch["query"].to_numpy(), batch["v"].to_numpy()
        bound = bins.bounds(_angles(_unit(batch["v"]), points))
        if first:
            best = bound.argmax(axis=1)
            part = np.array([zlib.crc32(q.encode()) for q in names], np.int64) % bins.parts[best]
            yield pd.DataFrame({"query": names, "v": v, "bin": best, "part": part})
            continue
        reach = bound >= batch["least"].fillna(-2.0).to_numpy()[:, None] - 1e-9
        met = batch["bin"].to_numpy(), batch["part"].to_numpy()
        who, wanted = np.nonzero(reach)
        n = bins.parts[wanted]
        who, each = np.repeat(who, n), np.repeat(wanted, n)
        part = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        new = np.flatnonzero((each != met[0][who]) | (part != met[1][who]))
        for start in range(0, len(new), _SENT):
            at = new[start : start + _SENT]
            yield pd.DataFrame({"query": names[who[at]], "v": v[who[at]], "bin": each[at], "part": part[at]})


def cosine_neighbors(
    queries: DataFrame,
    references: DataFrame,
    key: str,
    vector: str,
    k: int,
    exclude_self: bool = False,
    block: int = _BLOCK,
    pivots: int = 64,
) -> DataFrame:
    """(query, reference, cosine, rank): the exact k nearest references of each query.

    Cosines are rounded to twelve decimals, so that equal vectors tie wherever they were
    multiplied; ties go to the smaller reference name. A null vector, or one with a value
    that is not finite, is an error; a zero vector has cosine 0 with all others.

    References are put into the cells of up to ``pivots`` of them, the cells into up to 64 bins by
    the angle to the pivot, the bins into blocks of about ``block`` rows. A query first meets a
    block of its most promising bin. Its k-th cosine there rules out every bin that can't reach it by
    the triangle inequality for angles, and it meets the blocks of the others. So a reference is
    sent once (and once more for each ``64 * block`` queries at its block), a query once for each block
    that may matter, and no pair leaves a task unless it is among the k best of its block. What is held
    in the driver is the pivots and at most 65 x 64 bins.
    """
    held, bins, points = _placed(references, key, vector, block, pivots)
    crowd = 64 * block
    if not len(bins.cell):
        return _nothing(queries.sparkSession)
    asked = materialize(queries.select(F.col(key).cast("string").alias("query"), F.col(vector).alias("v")), "queries")

    width = asked.schema["v"].dataType.simpleString()
    schema = f"query string, v {width}, bin int, part int"
    one = materialize(asked.mapInPandas(lambda b: _visits(b, bins, points, True), schema), "round-1")
    near = materialize(_met(one, held, k, exclude_self, crowd), "near-1")
    least = near.groupBy("query").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    least = least.where(F.col("n") >= k).select("query", "least")
    two = one.join(least, "query", "left").select("query", "v", "bin", "part", "least").mapInPandas(lambda b: _visits(b, bins, points, False), schema)
    rest = _met(materialize(two, "round-2"), held, k, exclude_self, crowd)
    return topk_per_key(near.union(rest), ["query"], [F.desc("cosine"), F.asc("reference")], k)


def _nothing(spark) -> DataFrame:
    return spark.createDataFrame([], "query string, reference string, cosine double, rank int")


def _placed(references: DataFrame, key: str, vector: str, block: int, pivots: int) -> tuple[DataFrame, Bins, np.ndarray]:
    """The references (reference, v, bin, part), their bins, and the pivots."""
    points = _pivots(references, key, vector, pivots)
    cells = len(points)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            unit = _unit(batch["v"])
            angles = _angles(unit, points) if cells else np.full((len(unit), 1), np.nan)
            zero = np.isnan(angles[:, 0])
            cell = np.where(zero, cells, np.nan_to_num(angles).argmin(axis=1))
            angle = np.where(zero, 0.0, np.nan_to_num(angles).min(axis=1))
            yield pd.DataFrame({"reference": batch["reference"], "v": batch["v"], "cell": cell, "angle": angle})

    rows = references.select(F.col(key).cast("string").alias("reference"), F.col(vector).alias("v"))
    width = rows.schema["v"].dataType.simpleString()
    rows = materialize(rows.mapInPandas(run, f"reference string, v {width}, cell int, angle double"), "cells")
    spans = rows.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    spans = spans.select("cell", "low", "high", F.least(F.lit(64), F.ceil(F.col("n") / block)).alias("m"))
    wide = F.col("high") > F.col("low")
    slot = F.when(wide, F.floor((F.col("angle") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("m"))).otherwise(0)
    rows = rows.join(F.broadcast(spans), "cell").withColumn("slot", F.least(slot, F.col("m") - 1).cast("int"))  # 65 rows at most
    found = rows.groupBy("cell", "slot").agg(F.min("angle"), F.max("angle"), F.ceil(F.count("*") / block)).orderBy("cell", "slot").collect()
    table = np.array([tuple(r) for r in found], float).reshape(len(found), 5)
    bins = Bins(table[:, 0].astype(int), table[:, 2], table[:, 3], table[:, 4].astype(int))
    if not found:
        return rows, bins, points
    spark = references.sparkSession
    numbers = spark.createDataFrame([(int(r[0]), int(r[1]), i, int(r[4])) for i, r in enumerate(found)], "cell int, slot int, bin int, parts int")
    placed = rows.join(F.broadcast(numbers), ["cell", "slot"])  # 65 x 64 rows at most
    part = F.pmod(F.xxhash64("reference"), F.col("parts")).cast("int").alias("part")
    return materialize(placed.select("reference", "v", "bin", part), "blocks"), bins, points


def cosine_topk(
    queries: DataFrame,
    references: DataFrame,
    key: str,
    vector: str,
    k: int = 5,
    exclude_self: bool = False,
    block: int = _BLOCK,
) -> DataFrame:
    """Per query: highest cosine, mean of the k highest, and ``word:0.0000`` neighbours."""
    near = cosine_neighbors(queries, references, key, vector, k, exclude_self, block)
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("reference").alias("r")))
    )

    def label(s: Column) -> Column:
        return F.format_string("%s:%.4f", s["r"], -s["c"])

    return near.groupBy("query").agg(
        F.max("cosine").alias("max_cosine"),
        F.avg("cosine").alias("mean_topk_cosine"),
        F.array_join(F.transform(ordered, label), ";").alias("nearest_neighbors"),
    )
