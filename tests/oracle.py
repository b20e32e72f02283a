"""Compare a query's rows with what DuckDB makes of its SQL."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if columns and rows agree, else what differs."""
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    want = _rows(names, answer.fetchall())
    got = _rows(df.columns, df.collect())
    if got == want:
        return None
    missing, extra = want - got, got - want
    return (
        f"{sum(got.values())} rows vs {sum(want.values())}; "
        f"missing {list(missing)[:3]}; extra {list(extra)[:3]}"
    )
