"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name``; ``tables`` reads a table by attribute."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def cut_sql(text: str, n: int) -> str:
    """The first n bytes of a text in SQL; a character that the cut would split goes whole."""
    h = f"hex(encode({text}))"
    inside = lambda k: f"substr({h}, {2 * k + 1}, 1) IN ('8', '9', 'A', 'B')"
    size = f"CASE WHEN NOT {inside(n)} THEN {n} WHEN NOT {inside(n - 1)} THEN {n - 1} WHEN NOT {inside(n - 2)} THEN {n - 2} ELSE {n - 3} END"
    return f"CASE WHEN octet_length(encode({text})) <= {n} THEN {text} ELSE decode(unhex(substr({h}, 1, 2 * ({size})))) END"


def short_sql(text: str, n: int, marker: str = " ...") -> str:
    """The same with a marker behind it where something was cut."""
    return f"CASE WHEN octet_length(encode({text})) > {n} THEN ({cut_sql(text, n)}) || '{marker}' ELSE {text} END"
