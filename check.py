"""Run queries and their checking SQL side by side: python check.py [sf] [name-part ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from pairlens.catalog import CHECKS, QUERIES  # noqa: E402
from pairlens.plans.views import Tables  # noqa: E402


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .appName("check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in Tables.names:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        s = df[c]
        if pd.api.types.is_bool_dtype(s):
            s = s.map(lambda v: f"b{bool(v)}")
        elif pd.api.types.is_float_dtype(s):
            s = s.map(lambda v: None if pd.isna(v) else f"f{v!r}".replace("np.float64(", "").rstrip(")"))
        elif pd.api.types.is_integer_dtype(s):
            s = s.map(lambda v: None if pd.isna(v) else f"i{int(v)}")
        else:
            s = s.map(
                lambda v: None
                if v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NaT
                else f"b{v}" if isinstance(v, bool)
                else f"i{v}" if isinstance(v, (int, np.integer))
                else f"f{v!r}" if isinstance(v, float)
                else str(v)
            )
        out[c] = s.astype(object).where(s.notna(), "<null>")
    t = pd.DataFrame(out)
    return t.sort_values(list(t.columns)).reset_index(drop=True) if len(t.columns) else t


def spark_types(df) -> dict[str, str]:
    return dict(df.dtypes)


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, float]:
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    got = sdf.toPandas()
    took = time.time() - t0
    if name not in CHECKS:
        return f"rows only ({len(got)})", took
    rel = con.execute(CHECKS[name])
    want = rel.df()
    nullable_int = [c for c, ty in sdf.dtypes if ty == "bigint" and c in got]
    for c in nullable_int:
        got[c] = got[c].astype("Int64")
        if c in want and pd.api.types.is_float_dtype(want[c]) and want[c].isna().any():
            want[c] = want[c].astype("Int64")
    if set(got.columns) != set(want.columns):
        return f"COLUMNS spark={sorted(got.columns)} sql={sorted(want.columns)}", took
    if len(got) != len(want):
        return f"ROWS spark={len(got)} sql={len(want)}", took
    if len(got) == 0:
        return "EMPTY", took
    a, b = tidy(got), tidy(want)
    if a.equals(b):
        return f"ok ({len(got)})", took
    bad = [c for c in a.columns if not a[c].equals(b[c])]
    diff = (a != b).any(axis=1)
    shown = pd.concat({"spark": a[diff][bad].head(3), "sql": b[diff][bad].head(3)})
    return f"VALUES {int(diff.sum())} rows, columns {bad}\n{shown.to_string()[:1500]}", took


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("0") else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    names = [n for n in QUERIES if not args or any(a in n for a in args)]
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        try:
            result, took = compare(spark, con, sf_dir, name)
        except Exception as err:  # report and go on
            result, took = f"ERROR {str(err)[:900]}", 0.0
        good = result.startswith(("ok", "rows only"))
        bad += not good
        print(f"{'  ' if good else '!!'} {name:40s} {took:6.2f}s {result}", flush=True)
    print(f"{len(names) - bad}/{len(names)} good")
    spark.stop()


if __name__ == "__main__":
    main()
