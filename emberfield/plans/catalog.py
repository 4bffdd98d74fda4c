"""Registry of queries with, where SQL can express them, an equivalent statement for a SQL engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = (fn, sql)
        return fn

    return add


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Comparable output: rounded doubles without negative zero, 64-bit integers, arrays as text."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            c = F.concat_ws("|", c)
        out.append(c.alias(field.name))
    return df.select(*out)
