"""Numbering rows in one global order without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, name: str, order: list[str], bucket: Column, start: int = 0) -> DataFrame:
    """Add ``name``: start + 1, start + 2, ... by ``order``.

    ``bucket`` is a value that never falls along the order, such as the hour of the leading timestamp.
    Rows are counted by bucket, the counts are summed up in order of buckets, and rows are numbered
    within their bucket; only the counts, one row a bucket, meet in one task.
    """
    keyed = df.withColumn("__bucket", bucket)
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("__bucket").count().select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)).cast("long")
    ranked = keyed.withColumn("__rank", within)
    return ranked.join(offsets, ranked["__bucket"].eqNullSafe(offsets["__b"])).withColumn(name, F.col("__offset") + F.col("__rank") + F.lit(start)).drop("__bucket", "__b", "__offset", "__rank")
