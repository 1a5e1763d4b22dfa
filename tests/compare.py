"""Run a query and its SQL side by side and compare rows without order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 6)
    if hasattr(value, "is_finite"):
        return plain(float(value))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=str)


def differences(spark, sf, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = query(spark, sf)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = rows_of(names, cursor.fetchall())
    assert sorted(names) == sorted(got.columns), (names, got.columns)
    have = rows_of(got.columns, got.collect())
    assert len(have) == len(want), (len(have), len(want))
    return [(a, b) for a, b in zip(have, want, strict=True) if a != b]
