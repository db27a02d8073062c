"""Holding a query against its SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    show = lambda v: "" if v is None or pd.isna(v) is True else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


def expected(sql, sf_dir):
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        return db.sql(sql).df()


def hold(spark, query, sql, sf_dir):
    found, want = query(spark, sf_dir).toPandas(), expected(sql, sf_dir)
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want[found.columns])
