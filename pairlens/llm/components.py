"""Connected components of a table of links.

Links are contracted in blocks: a task joins the nodes of its block and gives back one
link from each node to the smallest of its group. If there are several blocks, large and
small stars alternate over what is left until nothing changes.
"""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Links that one task contracts.
BLOCK_LINKS = 500_000


def _contract(links: DataFrame) -> DataFrame:
    def run(batches):
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while (up := parent.setdefault(i, i)) != i:
                parent[i] = i = parent[up]
            return i

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        stars = [(i, top) for i in list(parent) if (top := root(i)) != i]
        columns = list(zip(*stars)) if stars else [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of them all."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them all."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (its smallest node) for each node that the links ``a``, ``b`` name.

    Each round is written to the shared folder, so lineage stays short; what travels to
    the driver is a count and a checksum. Links of a node with itself are ignored.
    """
    named = links.select("a", "b").where("a <> b")
    blocks = -(-named.count() // BLOCK_LINKS)
    current = scratch.keep(_contract(named.repartition(max(1, blocks))), f"{name}-0")
    before = None
    for n in count(1) if blocks > 1 else ():
        current = scratch.keep(_small_star(_large_star(current)), f"{name}-{n}")
        scratch.drop(f"{name}-{n - 1}")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.union(centres)
