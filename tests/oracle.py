"""Compares a query's rows with DuckDB's, whatever their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return float(f"{value:.9g}") if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def assert_equal(spark, sf_dir, query, sql):
    found = query(spark, sf_dir)
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    wanted = db.execute(sql)
    names = [x[0] for x in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(names, wanted.fetchall())
