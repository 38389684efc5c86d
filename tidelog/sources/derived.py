"""Logs derived from other tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.plans.ordering import numbered
from tidelog.schema import AGGREGATE


def _versioned(df: DataFrame) -> DataFrame:
    return df.withColumn("aggregate_version", F.row_number().over(Window.partitionBy(*AGGREGATE).orderBy("global_position")).cast("long"))


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the events table, in order of time and id; ``amount`` stands beside the log's own columns."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    rows = numbered(e, "global_position", ["ts", "event_id"], F.date_trunc("HOUR", "ts"))
    none = F.lit(None).cast("string")
    rows = rows.select(
        "global_position",
        F.when(kind == "purchase", "Sales").when(kind == "error", "Ops").otherwise("Identity").alias("bounded_context"),
        F.when(kind == "purchase", "Order").when(kind == "error", "Incident").otherwise("User").alias("aggregate_type"),
        F.col("user_id").cast("string").alias("aggregate_id"), F.col("event_id").cast("string").alias("event_id"), "event_type",
        (1 + F.col("event_id") % 2).cast("int").alias("event_version"), F.col("props").alias("payload"), none.alias("trace_id"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("corr-"), F.col("user_id").cast("string"))).alias("correlation_id"), none.alias("causation_id"), none.alias("metadata"),
        F.col("ts").alias("created_at"), F.col("value").alias("amount"),
    )
    return _versioned(rows)


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OrderPlaced a row of orders, in order of date and key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = numbered(o, "global_position", ["o_orderdate", "o_orderkey"], F.col("o_orderdate"))
    none = F.lit(None).cast("string")
    rows = rows.select(
        "global_position", F.lit("Sales").alias("bounded_context"), F.lit("Order").alias("aggregate_type"), F.col("o_orderkey").cast("string").alias("aggregate_id"), F.col("o_orderkey").cast("string").alias("event_id"),
        F.lit("OrderPlaced").alias("event_type"), F.lit(1).alias("event_version"), F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))).alias("payload"),
        none.alias("trace_id"), none.alias("correlation_id"), none.alias("causation_id"), none.alias("metadata"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("amount"),
    )
    return _versioned(rows)
