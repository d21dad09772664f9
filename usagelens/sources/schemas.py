"""Schemas of the account-usage tables."""

from __future__ import annotations

from pyspark.sql import types as T

QUERY_HISTORY = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("query_text", T.StringType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("warehouse_name", T.StringType()),
    T.StructField("warehouse_size", T.StringType()),
    T.StructField("execution_status", T.StringType()),
    T.StructField("total_elapsed_time", T.LongType()),
    T.StructField("execution_time", T.LongType()),
    T.StructField("queued_overload_time", T.LongType()),
    T.StructField("transaction_blocked_time", T.LongType()),
    T.StructField("bytes_scanned", T.LongType()),
    T.StructField("bytes_spilled_to_local_storage", T.LongType()),
    T.StructField("bytes_spilled_to_remote_storage", T.LongType()),
    T.StructField("partitions_scanned", T.LongType()),
    T.StructField("partitions_total", T.LongType()),
])

WAREHOUSE_METERING_HISTORY = T.StructType([
    T.StructField("warehouse_name", T.StringType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("credits_used", T.DecimalType(18, 2)),
])

QUERY_ACCELERATION_ELIGIBLE = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("query_text", T.StringType()),
    T.StructField("warehouse_name", T.StringType()),
    T.StructField("warehouse_size", T.StringType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("eligible_query_acceleration_time", T.LongType()),
    T.StructField("upper_limit_scale_factor", T.LongType()),
])

WAREHOUSES = T.StructType([T.StructField("name", T.StringType())])

ACCOUNTS = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
])
