"""Comparison of a Spark query with its SQL in DuckDB, over the same Parquet tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> int:
    """Rows that agree; an assertion tells the first difference."""
    df = query(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    relation = duck(sf_dir).sql(sql)
    wanted = canonical(relation.columns, relation.fetchall())
    assert sorted(df.columns) == sorted(relation.columns), (sorted(df.columns), sorted(relation.columns))
    assert len(got) == len(wanted), (len(got), len(wanted))
    for g, w in zip(got, wanted, strict=True):
        assert g == w, (sorted(df.columns), g, w)
    return len(got)
