"""Scans and sinks: CSV, JSON lines, word lists, many-run globs, partitioned outputs."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_corrupt_line"


def _csv(spark: SparkSession, sep: str = ",", multi_line: bool = False) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
    )


def _plain_name(name: str) -> str:
    return name.lstrip("\ufeff").strip()


def _by_header(
    spark: SparkSession,
    reader: Callable[[], DataFrameReader],
    paths: Sequence[str],
    schema: T.StructType | str,
    required: Sequence[str],
) -> DataFrame:
    """The schema's columns by name, from paths whose files share a header per path.

    One look at each path's header; paths with equal headers are scanned together. A file
    whose header differs from its path's is an error. A column that a header lacks is
    null there, unless it is required.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    types = {f.name: f.dataType for f in wanted.fields}
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        groups.setdefault(tuple(reader().csv(path).columns), []).append(path)
    frames = []
    for header, members in groups.items():
        names = [_plain_name(c) for c in header]
        missing = [c for c in required if c not in names]
        if missing:
            raise ValueError(f"columns {missing} are missing in {members[:3]}")
        own = T.StructType(
            [T.StructField(c, types.get(n, T.StringType())) for c, n in zip(header, names)]
        )
        given = dict(zip(names, header))
        rows = reader().schema(own).csv(members).withColumn("__path", F.input_file_name())
        columns = [
            (F.col(f"`{given[f.name]}`") if f.name in given else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted.fields
        ]
        frames.append(rows.select(*columns, "__path"))
    if not frames:
        return spark.createDataFrame([], T.StructType([*wanted.fields, T.StructField("__path", T.StringType())]))
    return union_all(frames)


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    sep: str = ",",
    tidy_header: bool = False,
    multi_line: bool = False,
    required: Sequence[str] = (),
) -> DataFrame:
    """CSV scan with a header; columns are taken by name. Quotes are doubled inside quoted fields.

    Extra columns of a file are left out and missing ones are null, or an error if they are
    ``required``. Files are split over tasks unless ``multi_line`` says that quoted
    fields may hold newlines. ``tidy_header`` strips a byte-order mark and blanks from the
    column names and lower-cases them; all columns are then read as strings.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if schema is not None:
        return _by_header(spark, lambda: _csv(spark, sep, multi_line), paths, schema, required).drop("__path")
    df = _csv(spark, sep, multi_line).csv(paths)
    if tidy_header:
        df = df.toDF(*[_plain_name(c).lower() for c in df.columns])
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-lines scan: blank lines are skipped, a malformed or non-object line is an error.

    The error is raised inside the scan, naming the text of the bad line, so no
    separate counting job runs.
    """
    full = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(
        "value",
        F.from_json(
            "value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
        ).alias("row"),
    )
    is_object = F.trim("value").startswith("{")
    bad = F.col(f"row.{_CORRUPT}").isNotNull() | ~is_object
    checked = F.when(
        bad,
        F.raise_error(F.concat(F.lit("invalid JSON object line: "), F.substring("value", 1, 200))),
    ).otherwise(F.col("row"))
    return parsed.select(checked.alias("row")).select(
        *[F.col(f"row.`{f.name}`").alias(f.name) for f in schema.fields]
    )


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """path, line_number (from 1, blank lines counted), line: the bad lines of JSON-lines files.

    A diagnostic for files that :func:`read_jsonl` refused. A scan keeps the lines of one
    file block together and in order; how many lines the blocks before it hold comes from
    one aggregation with a row for each block.
    """
    full = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),
    )
    blocks = lines.groupBy("path", "__block").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    earlier = W.partitionBy("path").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    row = F.from_json(
        "line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )
    bad = (
        lines.where(F.trim("line") != "")
        .withColumn("row", row)
        .where(F.col(f"row.{_CORRUPT}").isNotNull() | ~F.trim("line").startswith("{"))
    )
    number = F.col("__at") - F.col("__first") + F.col("__before") + 1
    return bad.join(blocks, ["path", "__block"]).select("path", number.alias("line_number"), "line")


def read_lexicon(
    spark: SparkSession, path: str, field: str = "nouns", minimum: int = 1
) -> DataFrame:
    """Word list inside a JSON object: trimmed, lower, unique, non-empty, at least ``minimum``."""
    schema = T.StructType([T.StructField(field, T.ArrayType(T.StringType()))])
    words = F.transform(field, lambda w: F.lower(F.trim(w)))
    df = spark.read.schema(schema).option("multiLine", True).json(path).select(words.alias("w"))
    fine = (
        (F.size("w") >= minimum)
        & (F.size(F.array_distinct("w")) == F.size("w"))
        & ~F.exists("w", lambda w: w == "")
    )
    return df.select(
        F.posexplode(
            F.when(F.coalesce(fine, F.lit(False)), F.col("w")).otherwise(
                F.raise_error(
                    F.lit(f"lexicon must hold at least {minimum} unique, non-empty words")
                )
            )
        ).alias("position", "word")
    )


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct letters-only lower-case words of a one-word-per-line file."""
    word = F.lower(F.trim("value"))
    return (
        spark.read.text(path)
        .select(word.alias("word"))
        .where(F.col("word").rlike("^[a-z]+$"))
        .distinct()
    )


def scan_runs(
    spark: SparkSession,
    root: str | Sequence[str],
    file_name: str,
    schema: T.StructType | str,
    contains: Sequence[str] = (),
    multi_line: bool = False,
    required: Sequence[str] = (),
) -> DataFrame:
    """Files of one name (a glob) at any depth below the roots, with their ``source_path``.

    Paths are listed once, sorted and distinct; only folders with a path that contains one of
    the tokens are read. Columns are taken by name from each folder's own header.
    """
    roots = [root] if isinstance(root, str) else list(root)
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_name)
        .load(roots)
        .select("path")
        .distinct()
    )
    found = sorted(r.path for r in listed.collect())
    chosen = [p for p in found if not contains or any(token in p for token in contains)]
    folders = sorted({p.rsplit("/", 1)[0] for p in chosen})
    rows = _by_header(
        spark,
        lambda: _csv(spark, multi_line=multi_line).option("pathGlobFilter", file_name),
        folders, schema, required,
    )
    return rows.withColumnRenamed("__path", "source_path")


def read_optional(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """The table at ``path``, or an empty one with the same columns when it is missing."""
    try:
        return spark.read.schema(schema).format(fmt).option("header", True).load(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], schema)


def model_run(path: Column, prefix: str = "colab_") -> Column:
    """First path part that starts with ``prefix``."""
    found = F.regexp_extract(path, f"(?:^|/)({prefix}[^/]*)", 1)
    return F.when(found != "", found).otherwise("unknown_model")


def dataset_of(path: Column) -> Column:
    """Dataset by whole path part, then by substring; mixed before nonce before core."""
    names = ("core_targets_jabberwocky_primes", "jabberwocky", "core")
    out = None
    for name in names:
        part = path.rlike(f"(^|/){name}(/|$)")
        out = F.when(part, name) if out is None else out.when(part, name)
    for name in names:
        out = out.when(path.contains(name), name)
    return out.otherwise("unspecified")


def add_source_columns(df: DataFrame, path: str = "source_path") -> DataFrame:
    return df.withColumns(
        {"source_model_run": model_run(F.col(path)), "dataset": dataset_of(F.col(path))}
    )


def pick_by_priority(
    paths: DataFrame, keys: Sequence[str], path: str, patterns: Sequence[str]
) -> DataFrame:
    """One path per key: the earliest matching pattern wins, then the first path."""
    rank = F.lit(len(patterns))
    for index in reversed(range(len(patterns))):
        rank = F.when(F.col(path).contains(patterns[index]), index).otherwise(rank)
    best = F.min(F.struct(rank.alias("priority"), F.col(path).alias("path")))
    return (
        paths.groupBy(*keys)
        .agg(best.alias("best"))
        .select(*keys, F.col("best.path").alias(path), F.col("best.priority").alias("priority"))
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing on one side is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def write_outputs(outputs: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    for name, df in outputs.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.format(fmt).save(f"{root}/{name}")


def manifest(outputs: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each output, as one query over all of them."""
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("output"),
            "n_rows",
            F.lit(len(df.columns)).alias("n_columns"),
            F.lit(json.dumps(df.columns)).alias("columns"),
        )
        for name, df in outputs.items()
    ]
    return union_all(counts)


def read_outputs(spark: SparkSession, names: Sequence[str], root: str) -> dict[str, DataFrame]:
    """The outputs of :func:`write_outputs` in parquet, read back."""
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}


def long_values(outputs: Mapping[str, DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """output, key, metric, value: every number of every output as a row.

    ``key`` is JSON of the row's strings and of the columns named in ``keys``. Missing numbers
    stay as rows with a null value.
    """
    frames = []
    for name, df in outputs.items():
        told = [f.name for f in df.schema if f.name in keys or isinstance(f.dataType, T.StringType)]
        cells = [
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in df.columns
            if c not in told
        ]
        key = F.to_json(F.struct(*told), {"ignoreNullFields": "false"}) if told else F.lit("{}")
        rows = df.select(F.lit(name).alias("output"), key.alias("key"), F.explode(F.array(*cells)).alias("c"))
        frames.append(rows.select("output", "key", "c.*"))
    return union_all(frames)


def write_manifest(outputs: Mapping[str, DataFrame], root: str) -> None:
    """The manifest as JSON lines (one line per output)."""
    manifest(outputs).coalesce(1).write.mode("overwrite").json(f"{root}/manifest")


def _done_marker(root: str, key: str, value: str) -> str:
    return f"{root}/_done/{key}={value}"


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.format("text").load(path).columns)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return False


def run_partitioned(df: DataFrame, by: str, values: Sequence[str], root: str) -> list[str]:
    """Write one partition per value of ``by`` and mark it done; finished ones are skipped.

    All unfinished values are one dynamic-partition overwrite; markers with the rows
    read back follow in one more job, so a rerun after a failure redoes only what is missing.
    Returns the values written now.
    """
    spark = df.sparkSession
    unfinished = [v for v in dict.fromkeys(values) if not _exists(spark, _done_marker(root, by, v))]
    if not unfinished:
        return []
    (
        df.where(F.col(by).isin(unfinished))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(f"{root}/data")
    )
    rows = spark.read.schema(df.schema).parquet(f"{root}/data")
    counts = rows.where(F.col(by).isin(unfinished)).groupBy(F.col(by).cast("string").alias(by)).count()
    asked = spark.createDataFrame([(str(v),) for v in unfinished], f"`{by}` string")
    done = asked.join(counts, by, "left").select(by, F.coalesce("count", F.lit(0)).cast("string").alias("value"))
    (
        done.coalesce(1).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .text(f"{root}/_done")
    )
    return unfinished


def read_partitioned(
    spark: SparkSession, by: str, values: Sequence[str], root: str
) -> DataFrame:
    """All finished partitions; a missing one is an error."""
    missing = [v for v in values if not _exists(spark, _done_marker(root, by, v))]
    if missing:
        raise FileNotFoundError(f"unfinished partitions of {by}: {missing}")
    return spark.read.parquet(f"{root}/data").where(F.col(by).isin(list(values)))


def order_columns(df: DataFrame, preferred: Sequence[str], rest: bool = True) -> DataFrame:
    """Preferred columns first (missing ones skipped), then the others."""
    first = [c for c in preferred if c in df.columns]
    tail = [c for c in df.columns if c not in first] if rest else []
    return df.select(*first, *tail)


def export_review(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns a human reviewer sees, in order; missing ones are skipped."""
    return order_columns(df, columns, rest=False)
