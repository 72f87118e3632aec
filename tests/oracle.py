"""Runs queries beside their DuckDB statements and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pyarrow as pa


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def _cell(v: object) -> str:
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, list):
        return str([_cell(x) for x in v])
    return str(v)


def rows(table: pa.Table) -> list[str]:
    names = sorted(table.column_names)
    return sorted("|".join(_cell(v) for v in r) for r in zip(*(table[n].to_pylist() for n in names)))


def compare(spark, con, sf_dir: str, run, sql: str) -> str | None:
    """None if the rows agree, else what differs."""
    got, want = run(spark, sf_dir).toArrow(), con.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} and {sorted(want.column_names)}"
    kinds = [(n, str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in sorted(got.column_names)]
    a, b = rows(got), rows(want)
    if a != b:
        odd = [x for x in zip(a, b) if x[0] != x[1]][:2]
        return f"{len(a)} and {len(b)} rows; {kinds}; {odd}"
    return None
