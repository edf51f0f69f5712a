"""Holds a query's rows against those of its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def shown(value):
    if value is None or (isinstance(value, float) and value != value):
        return "-"
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


def sql_rows(sql, folder=SMALL):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(sql)
    return sorted(d[0] for d in found.description), rows_of([d[0] for d in found.description], found.fetchall())


def check(spark, query, sql, folder=SMALL):
    df = query(spark, folder)
    columns, expected = sql_rows(sql, folder)
    assert sorted(df.columns) == columns
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == expected
