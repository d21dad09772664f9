"""Account-usage tables derived from the bundled ``events`` table.

Every event becomes one query of the history.  The expressions are portable SQL, and the independent
checks use the same texts so that both engines see the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import UsageTables

# The mapping that the fixtures prescribe.

SEED_EXPRESSIONS = (
    "event_id",
    "ts",
    "user_id",
    "event_type",
    "props",
    "(event_id * 7919 + 13) % 10007 AS ha",
    "(event_id * 104729 + 17) % 10009 AS hb",
    "(event_id * 1299709 + 19) % 10037 AS hc",
    "(event_id * 15485863 + 23) % 10039 AS hd",
)

MEASURE_EXPRESSIONS = (
    "*",
    "CASE WHEN ha % 40 = 0 THEN 0 ELSE CAST(power(2, ha % 24) AS BIGINT) + hb % 1000 END AS el",
    "CASE hc % 6 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 30 WHEN 3 THEN 120 WHEN 4 THEN 350 ELSE 700 END AS qp",
    "CASE hd % 6 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 30 WHEN 3 THEN 120 WHEN 4 THEN 350 ELSE 700 END AS bp",
    "CASE WHEN hd % 10 = 0 THEN 0 ELSE 1 + ha % 1000 END AS pt",
)

WAIT_EXPRESSIONS = (
    "*",
    "CAST(floor(el * qp / 1000) AS BIGINT) AS queued",
    "CAST(floor(el * bp / 1000) AS BIGINT) AS blocked",
)

HISTORY_EXPRESSIONS = (
    "ha",
    "hc",
    "hd",
    "concat('q', CAST(event_id AS STRING)) AS query_id",
    "concat('/* ', event_type, ' */ ', props) AS query_text",
    "ts AS start_time",
    "concat('WH_', CAST(user_id % 4 AS STRING)) AS warehouse_name",
    "CASE WHEN hb % 20 = 0 THEN NULL ELSE CASE user_id % 4 + ha % 2 WHEN 0 THEN 'X-Small' WHEN 1 THEN 'Small'"
    " WHEN 2 THEN 'Medium' WHEN 3 THEN 'Large' ELSE '6X-Large' END END AS warehouse_size",
    "CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status",
    "CAST(el AS BIGINT) AS total_elapsed_time",
    "CAST(GREATEST(el - queued - blocked, 0) AS BIGINT) AS execution_time",
    "queued AS queued_overload_time",
    "blocked AS transaction_blocked_time",
    "CASE WHEN hb % 15 = 0 THEN 0 ELSE CAST(power(2, hb % 38) AS BIGINT) + hc END AS bytes_scanned",
    "CASE WHEN hc % 3 = 0 THEN 0 ELSE CAST(power(2, hc % 43) AS BIGINT) END AS bytes_spilled_to_local_storage",
    "CASE WHEN hd % 2 = 0 THEN 0 ELSE CAST(power(2, (hd + ha) % 42) AS BIGINT) END AS bytes_spilled_to_remote_storage",
    "CAST(floor(pt * (hb % 101) / 100) AS BIGINT) AS partitions_scanned",
    "CAST(pt AS BIGINT) AS partitions_total",
)

METERING_KEYS = ("warehouse_name", "date_trunc('hour', start_time) AS start_time")
METERING_CREDITS = "CAST(count(*) * 0.25 AS DECIMAL(18,2)) AS credits_used"

ELIGIBLE_CONDITION = "hc % 7 = 0"
ELIGIBLE_EXPRESSIONS = (
    "query_id",
    "query_text",
    "warehouse_name",
    "warehouse_size",
    "start_time",
    "CAST(ha % 3600 AS BIGINT) AS eligible_query_acceleration_time",
    "CAST(1 + hd % 64 AS BIGINT) AS upper_limit_scale_factor",
)


EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def read_test_table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _seeded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read_test_table(spark, sf_dir, "events", EVENTS_SCHEMA)
        .selectExpr(*SEED_EXPRESSIONS)
        .selectExpr(*MEASURE_EXPRESSIONS)
        .selectExpr(*WAIT_EXPRESSIONS)
        .selectExpr(*HISTORY_EXPRESSIONS)
    )


def query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded_history(spark, sf_dir).drop("ha", "hc", "hd")


def warehouse_metering_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        query_history(spark, sf_dir)
        .selectExpr(*METERING_KEYS)
        # Spark truncates to an instant; the table stores UTC wall clock like the history.
        .withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
        .groupBy("warehouse_name", "start_time")
        .agg(F.expr(METERING_CREDITS))
    )


def query_acceleration_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded_history(spark, sf_dir).where(ELIGIBLE_CONDITION).selectExpr(*ELIGIBLE_EXPRESSIONS)


def warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_history(spark, sf_dir).selectExpr("warehouse_name AS name").distinct()


def usage_tables(spark: SparkSession, sf_dir: str) -> UsageTables:
    """The four input tables over ``sf_dir/events.parquet``."""
    return UsageTables(
        query_history=query_history(spark, sf_dir),
        warehouse_metering_history=warehouse_metering_history(spark, sf_dir),
        query_acceleration_eligible=query_acceleration_eligible(spark, sf_dir),
        warehouses=warehouses(spark, sf_dir),
    )
