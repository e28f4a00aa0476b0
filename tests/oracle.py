"""Compares a query with its SQL on DuckDB."""

from pathlib import Path

import duckdb


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in Path(sf_dir).glob("*.parquet"):
        source = f"{table}/*.parquet" if table.is_dir() else table
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{source}')")
    found = db.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return [_plain(x) for x in value]
    return str(value) if value is not None and not isinstance(value, (int, bool)) else value


def canonical(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def assert_same(spark, name: str, query, sql: str, sf_dir: str) -> None:
    frame = query(spark, sf_dir)
    names, rows = sql_rows(sf_dir, sql)
    assert sorted(frame.columns) == sorted(names), name
    ours, theirs = canonical(frame.columns, [tuple(r) for r in frame.collect()]), canonical(names, rows)
    assert len(ours) == len(theirs), f"{name}: {len(ours)} and {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not wrong, f"{name}: {len(wrong)} of {len(ours)} rows differ: {wrong[:2]}"
