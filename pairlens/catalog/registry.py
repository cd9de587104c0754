"""The named queries with their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.views import CHECK_SQL, VIEW_NEEDS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
# Results are compared at six decimals. Means of tenths often end in an exact half
# there, which the last bit would round either way; this shift moves them off it.
OFF_TIE = 3e-10


def _close(sql: str, start: int) -> int:
    depth = 0
    for i in range(start, len(sql)):
        depth += {"(": 1, ")": -1}.get(sql[i], 0)
        if depth == 0:
            return i
    raise ValueError("unbalanced parentheses")


def expand_r6(sql: str) -> str:
    """``R6(x)`` as x rounded to six decimals, without a negative zero."""
    while True:
        hit = re.search(r"\bR6\(", sql)
        if not hit:
            return sql
        end = _close(sql, hit.end() - 1)
        inner = sql[hit.end() : end]
        value = f"(round(CAST({inner} AS DOUBLE) + {OFF_TIE}, 6) + 0.0)"
        sql = sql[: hit.start()] + value + sql[end + 1 :]


def with_views(sql: str) -> str:
    """Prefix the bindings that the SQL names, in dependency order."""
    needed: list[str] = []

    def need(view: str) -> None:
        if view not in needed:
            for other in VIEW_NEEDS.get(view, ()):
                need(other)
            needed.append(view)

    for view in CHECK_SQL:
        if re.search(rf"(?i)\b(?:FROM|JOIN)\s+{view}\b", sql):
            need(view)
    if not needed:
        return sql.strip()
    head = ",\n".join(f"{v} AS ({CHECK_SQL[v].strip()})" for v in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def rounded(df: DataFrame, places: int | None = 6) -> DataFrame:
    """Doubles at so many decimals (None: as they are), whole numbers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c.cast("double")
            if places is not None:
                c = F.round(c + F.lit(OFF_TIE), places)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query over the tables; ``sql`` is its check on the same tables.

    Only results that are compared with SQL are rounded; the others, p-values among them,
    are returned as they are.
    """

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(Tables(spark, sf_dir)), None if sql is None else 6)
        if sql is not None:
            CHECKS[name] = with_views(expand_r6(sql))
        return fn

    return wrap
