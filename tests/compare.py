"""Compare a query with its SQL, rows as sorted tuples."""

import glob
import os

import duckdb


def database(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(frame):
    def plain(x):
        if x is None or x != x:
            return None
        return round(x, 6) if isinstance(x, float) else x

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(plain(v)) for v in r) for r in frame.astype(object).itertuples(index=False, name=None))


def check(spark, folder, query, sql):
    got, want = query(spark, folder).toPandas(), database(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
