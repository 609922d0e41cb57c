"""Where queries register themselves."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with the SQL that gives the same rows where there is some."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_udf(kind: str):
    """An Arrow function that is made when a query uses it, for a type needs a session."""

    def wrap(f):
        def call(*cols):
            from pyspark.sql.functions import arrow_udf

            return arrow_udf(f, kind)(*cols)

        return call

    return wrap
