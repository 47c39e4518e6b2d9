"""Where the registered queries and their DuckDB SQL are kept."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df, *names):
    # Adding zero turns a negative zero into a positive one, in which engines differ.
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names})
