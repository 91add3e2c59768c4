"""Run a registered query in Spark and its SQL text in DuckDB and compare whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

KIND = {
    "tinyint": "TINYINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else v) for v in row)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences, empty when both agree: columns, types, row count, every value."""
    cursor = con.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in cursor.description}
    names = sorted(sql_types)
    if sorted(df.columns) != names:
        return [f"columns {sorted(df.columns)} != {names}"]
    spark_types = {n: KIND.get(t, t) for n, t in df.dtypes}
    issues = [f"type of {n}: {spark_types[n]} != {sql_types[n]}" for n in names if spark_types[n] != sql_types[n]]
    order = [d[0] for d in cursor.description]
    expected = sorted((tuple(r[order.index(n)] for n in names) for r in cursor.fetchall()), key=_key)
    actual = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    if len(expected) != len(actual):
        return [*issues, f"rows {len(actual)} != {len(expected)}"]
    wrong = [(a, e) for a, e in zip(actual, expected) if not _same(a, e)]
    exact = sum(a != e for a, e in zip(actual, expected))
    if wrong:
        issues.append(f"{len(wrong)} rows differ, e.g. {str(wrong[0])[:600]}")
    elif exact:
        pair = next((a, e) for a, e in zip(actual, expected) if a != e)
        issues.append(f"{exact} rows differ in the last digits, e.g. {str(pair)[:300]}")
    return issues


def _same(a: tuple, b: tuple) -> bool:
    return all(
        x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))
        for x, y in zip(a, b)
    )
