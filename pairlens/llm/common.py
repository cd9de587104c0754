"""What the operators share: intermediate tables, text bytes, hashing of arrays."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


#: Lists that note the folders made while they are open.
_LISTS: list[list[Scratch]] = []


@contextmanager
def noted() -> Iterator[list[Scratch]]:
    """A list of the folders that are made within the block."""
    made: list[Scratch] = []
    _LISTS.append(made)
    try:
        yield made
    finally:
        _LISTS.remove(made)


class Scratch:
    """Intermediate tables of one run, below the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only a local-mode session
    without that setting (tests) gets a temporary folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.conf.get(_CONF, None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError(f"set {_CONF} to a folder shared by all executors")
            app = spark.sparkContext.applicationId
            if app not in _LOCAL:
                _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="pairlens-")
            root = _LOCAL[app]
        self.path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        for made in _LISTS:
            made.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read back: lineage is cut, executors may go."""
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them, once nothing reads it any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text of ``docs``, a null text as the empty one."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def even(df: DataFrame) -> DataFrame:
    """Rows dealt evenly, for narrow tables that feed costly tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def about(rows: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """About ``n`` of ``total`` rows, chosen by a hash of ``key``; all of them if they are no more.

    Nothing is sorted or gathered for it. The number varies by a few square roots of ``n``.
    """
    if total <= n:
        return rows
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * n / total))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words, so that any bits may serve as a hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


HASHED = 1 << 15
_FACTORS: list[np.ndarray] = []


def _factors(n: int) -> list[np.ndarray]:
    """Two tables of scrambled numbers, one for each place up to ``n``."""
    if not _FACTORS or len(_FACTORS[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _FACTORS[:] = [mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(key)) for key in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
    return _FACTORS


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of disjoint slices, in ascending order, of an array of numbers below 2**24.

    Each is a sum of the values times a scrambled factor for their place in the slice: the factors
    follow no rule that texts could, so unlike a polynomial modulo 2**64 no texts collide by their build.
    """
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(values) + HASHED, HASHED)))
    out = np.empty((2, len(starts)), np.uint64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # parts that stay in a processor's cache
        low = starts[a]
        out[:, a:b] = _slice_hashes(values[low : ends[b - 1]], starts[a:b] - low, ends[a:b] - low)
    return out[0], out[1]


def _slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    n = len(values)
    size = ends - starts
    begin = np.zeros(n, np.int64)
    begin[starts] = starts
    np.maximum.accumulate(begin, out=begin)
    place = np.subtract(np.arange(n), begin, out=begin)
    longest = int(size.max())
    np.minimum(place, longest - 1, out=place)  # between slices the place does not matter
    sums, out = np.zeros(n + 1, np.uint64), []
    with np.errstate(over="ignore"):
        own = values.astype(np.uint64)
        own += np.uint64(1)
        for table in _factors(longest):
            term = table.take(place)
            term *= own
            np.cumsum(term, out=sums[1:])
            total = sums[ends]
            total -= sums[starts]
            total += size.astype(np.uint64)
            out.append(mix(total))
    return out


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One index of each distinct pair of hashes, each row's place among them, and their counts."""
    _, one, back, n = np.unique(first, return_index=True, return_inverse=True, return_counts=True)
    if (second[one][back] != second).any():
        both = np.stack([first, second], axis=1)
        _, one, back, n = np.unique(both, axis=0, return_index=True, return_inverse=True, return_counts=True)
    return one, back.reshape(-1), n


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all slices [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    first = np.zeros(len(n), np.int64)
    np.cumsum(n[:-1], out=first[1:])
    out[first] = s
    out[first[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out, out=out)


def crc(data) -> int:
    """Unsigned crc32 of an array's or string's bytes."""
    return zlib.crc32(data) & 0xFFFFFFFF


def chunks(values: Sequence, sizes: list[int], most: int):
    """Index ranges of ``values`` of about ``most`` in summed size, one item at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(values):
        yield start, len(values)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes in a string or binary column, one row at least."""
    for a, b in chunks(range(batch.num_rows), pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), most):
        yield batch.slice(a, b - a)
