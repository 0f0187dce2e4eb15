"""Runs a query beside its oracle SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    return None if value is None or value != value else float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def same_rows(df, con, sql: str) -> None:
    got, want = df.toPandas(), con.execute(sql).fetchdf()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)

    def rows(frame):
        frame = frame[columns].astype(object).where(frame[columns].notna(), None)
        return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)

    assert rows(got) == rows(want)
