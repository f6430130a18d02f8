"""Spark rows against DuckDB rows over the same tables."""

import duckdb


def duck(sf_dir: str, sql: str):
    import glob
    import os

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.sql(sql).df()


def rows(df, columns) -> list:
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(tidy, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist()), key=str)


def assert_same(spark_df, duck_df) -> None:
    columns = sorted(spark_df.columns)
    assert columns == sorted(duck_df.columns)
    assert list(map(str, rows(spark_df, columns))) == list(map(str, rows(duck_df, columns)))
