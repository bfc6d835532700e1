"""Compare a DataFrame with DuckDB SQL over the same tables, as sets of rows with counts."""

from collections import Counter
from pathlib import Path

import duckdb


def connection(folder):
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(frame, columns):
    return Counter(tuple(None if v != v else str(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def same(df, sql, folder):
    got, want = df.toPandas(), connection(folder).sql(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
