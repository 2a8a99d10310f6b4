"""Compare registered queries with their SQL in DuckDB on the small tables."""

import glob
import os
from collections import Counter

SMALL = "/root/testdata/sf0.001"


def connect(folder=SMALL):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(x) for x in value)
    return value


def same(spark, con, query, sql, folder=SMALL):
    df = query(spark, folder)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = Counter(tuple(_plain(row[columns.index(c)]) for c in sorted(columns)) for row in found.fetchall())
    got = Counter(tuple(_plain(row[c]) for c in sorted(columns)) for row in df.collect())
    assert got == expected
