"""Run registered queries against their SQL counterparts: ``python -m tests.compare SF [name part]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

from hourlake.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8):
    spark = build_session(
        "hourlake-check",
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": str(cores),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows as comparable tuples, columns by name, in a fixed order."""
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
                cells.append("null")
            elif isinstance(v, float):
                cells.append(str(int(v)) if v == int(v) else repr(v))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and "O" not in k and got[c].notna().all()}
    if odd:
        return f"types {odd}"
    a, b = canonical(got), canonical(want)
    if a != b:
        in_a, in_b = set(a), set(b)
        left, right = [r for r in a if r not in in_b], [r for r in b if r not in in_a]
        return f"{len(left)} rows differ, first {left[:2]} expected {right[:2]}"
    return None


def main() -> int:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    part = sys.argv[2] if len(sys.argv) > 2 else ""
    sf_dir = os.environ.get("SF_DIR", f"/root/testdata/sf{sf}")
    spark, con = session(), oracle(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if part and not any(p == name or (p.endswith("*") and p[:-1] in name) for p in part.split(",")):
            continue
        started = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - started
            problem = differences(got, con.execute(sqls[name]).df()) if name in sqls else None
        except Exception as e:
            took, problem, got = time.time() - started, f"{type(e).__name__}: {str(e)[:600]}", []
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {len(got)} rows {took:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
