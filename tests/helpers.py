from __future__ import annotations

from datetime import datetime

from usagelens.sources import schemas

GB = 1 << 30

DEFAULTS = {
    "query_id": "q",
    "query_text": "select 1",
    "start_time": datetime(2024, 1, 10, 12, 0),
    "warehouse_name": "WH",
    "warehouse_size": "Small",
    "execution_status": "SUCCESS",
    "total_elapsed_time": 1000,
    "execution_time": 1000,
    "queued_overload_time": 0,
    "transaction_blocked_time": 0,
    "bytes_scanned": 1,
    "bytes_spilled_to_local_storage": 0,
    "bytes_spilled_to_remote_storage": 0,
    "partitions_scanned": 1,
    "partitions_total": 1,
}


def history(spark, rows):
    """A query history from partial rows; ids are numbered in order."""
    full = [{**DEFAULTS, "query_id": f"q{i:03d}", **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.QUERY_HISTORY) for r in full], schemas.QUERY_HISTORY)


def counts(histogram, range_column):
    """Bucket counts by ordinal."""
    return {int(r[range_column].split(":")[0]): r["sql_count"] for r in histogram.collect()}


def query_ids(df):
    return [r["query_id"] for r in df.collect()]
