"""Compares a query with its DuckDB SQL, the order of rows aside."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def duck(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: repr(float(x)) if isinstance(x, float) else repr(int(x)) if isinstance(x, bool) is False and hasattr(x, "as_integer_ratio") else repr(x)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def differences(spark, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    c = duck(sf_dir).execute(sql)
    want_columns = [d[0] for d in c.description]
    want = rows_of(want_columns, c.fetchall())
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} and {sorted(want_columns)}"
    if got != want:
        return f"{len(got)} and {len(want)} rows; {[x for x in got if x not in set(want)][:2]} and {[x for x in want if x not in set(got)][:2]}"
    return None
