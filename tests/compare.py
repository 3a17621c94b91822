"""Compare a Spark result with a SQL result: same columns, same rows in any order."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_cell(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=repr)


def differences(spark_df, con, sql: str) -> str:
    """Empty when equal, else the first difference."""
    left = spark_df.toArrow()
    right = con.sql(sql).to_arrow_table()
    if sorted(left.column_names) != sorted(right.column_names):
        return f"columns {sorted(left.column_names)} != {sorted(right.column_names)}"
    a, b = _rows(left), _rows(right)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows; first {a[:1]} / {b[:1]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x!r:.1500} != {y!r:.1500}"
    types = {n: (str(left.schema.field(n).type), str(right.schema.field(n).type))
             for n in left.column_names}
    odd = {n: t for n, t in types.items() if t[0] != t[1]}
    return f"types {odd}" if odd else ""
