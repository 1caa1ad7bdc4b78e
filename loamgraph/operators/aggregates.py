"""Aggregates over string metadata, and places within a radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import scalars as S


def _numbers(value: Column) -> list[Column]:
    some = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        F.count(value).alias("count"),
        some(F.sum(value)).alias("sum"),
        some(F.avg(value)).alias("avg"),
        some(F.min(value)).alias("min"),
        some(F.max(value)).alias("max"),
    ]


def count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("count"))


def aggregate(rows: DataFrame, value: Column) -> DataFrame:
    """count, sum, avg, min and max of a text value; what is no number is skipped; no row gives zeros."""
    return rows.select(S.parse_number(value).alias("v")).agg(*_numbers(F.col("v")))


def group_aggregate(rows: DataFrame, group: Column, value: Column | None = None, name: str = "group_key") -> DataFrame:
    """As aggregate() for each group; rows without the key are out, groups without a number stay.

    Without a value, count is the number of rows.
    """
    if value is None:
        return rows.select(group.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("count"))
    return rows.select(group.alias(name), S.parse_number(value).alias("v")).where(F.col(name).isNotNull()).groupBy(name).agg(*_numbers(F.col("v")))


def geo_radius(rows: DataFrame, lat: float, lon: float, metres: float, *, lat_col: str = "lat", lon_col: str = "lon", id_col: str = "id", k: int | None = None) -> DataFrame:
    """Rows within the radius with `distance_m`, nearest first; a latitude band goes to the scan as a filter."""
    band = metres / 111_194.0 + 1e-6
    near = rows.where(F.col(lat_col).between(lat - band, lat + band))
    d = near.withColumn("distance_m", S.haversine(F.lit(lat), F.lit(lon), F.col(lat_col), F.col(lon_col))).where(F.col("distance_m") <= metres)
    d = d.orderBy("distance_m", id_col)
    return d if k is None else d.limit(k)
