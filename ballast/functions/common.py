"""Small column helpers used everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def codes(*checks: tuple[Column, str]) -> Column:
    """An array of the codes whose condition holds; a null condition does not hold."""
    return coded(*[F.when(cond, F.lit(code)) for cond, code in checks])


def coded(*found: Column) -> Column:
    """An array of the codes that are not null; codes have no control characters and are not empty.

    No lambda: Spark would evaluate all that leads to its argument without generated code.
    """
    text = F.concat_ws("\u0001", *found)
    # most rows have none
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\u0001"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.floor(seconds * 1_000_000).cast("bigint"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns that later filters and columns then read without computing them again.

    A plain column may be substituted into every later use of it, filters
    included; a generated one is computed where it stands.
    """
    packed = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    return df.withColumn("_once", packed).select("*", "_once.*").drop("_once")
