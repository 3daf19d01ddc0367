"""Compares a Spark result with DuckDB's for the SQL of the same query."""

from pathlib import Path

import duckdb


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, want = rows_of_sql(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    assert len(got) == len(want)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert got
