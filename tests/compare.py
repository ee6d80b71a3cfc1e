"""Order-free comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: float(v) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sf_dir: str, sql: str) -> None:
    names, rows = oracle(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    got, want = canonical(df.columns, [tuple(r) for r in df.collect()]), canonical(names, rows)
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not wrong, wrong[:3]
