"""Registered queries and the layout of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LARGE = 1e12  # doubles from here on are compared as they are


def tidy(df: DataFrame) -> DataFrame:
    """Result layout that engines agree on: bigint, double with six places, text, times in microseconds."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            column = F.when(F.abs(column) < LARGE, F.floor(column * 1e6 + 0.5) / 1e6).otherwise(column.cast("double"))
        elif isinstance(kind, T.TimestampType):
            column = F.unix_micros(column)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            column = column.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), " ")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, folder: tidy(function(spark, folder))
        return function

    return register
