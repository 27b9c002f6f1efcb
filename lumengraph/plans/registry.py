"""The list of registered queries: a Spark builder and, where possible, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Added before rounding on both sides: exact decimals such as 0.7578125 would otherwise
# round up or down by the last bit of a sum.
NUDGE = 3e-11


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column, so that both engines print the same digits."""
    out: list[Column] = []
    for field in df.schema.fields:
        col = F.col(field.name)
        if field.dataType.typeName() == "double":
            col = (F.round(col + NUDGE, places) + F.lit(0.0)).alias(field.name)
        out.append(col)
    return df.select(*out)
