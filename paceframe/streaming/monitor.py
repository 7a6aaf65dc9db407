"""Progress of streaming queries as rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

PROGRESS = (
    "id string, name string, batch_id bigint, input_rows bigint, processed_rows_per_s double, "
    "dropped_by_watermark bigint, timestamp string"
)


def _row(progress: dict) -> tuple:
    dropped = sum(op.get("numRowsDroppedByWatermark", 0) for op in progress.get("stateOperators", []))
    return (
        progress["id"], progress.get("name"), progress["batchId"], progress["numInputRows"],
        float(progress.get("processedRowsPerSecond") or 0.0), dropped, progress["timestamp"],
    )


def _as_dict(progress) -> dict:
    return json.loads(progress.json) if hasattr(progress, "json") else progress


def progress_table(query: StreamingQuery) -> DataFrame:
    """One row per recent batch (Spark keeps a bounded number of them), with late rows dropped."""
    spark = SparkSession.active()
    return spark.createDataFrame([_row(_as_dict(p)) for p in query.recentProgress], PROGRESS)


def active_queries(spark: SparkSession) -> DataFrame:
    """Running queries, their state and last batch."""
    rows = []
    for q in spark.streams.active:
        last = q.lastProgress
        rows.append((str(q.id), q.name, q.status["message"], _as_dict(last)["batchId"] if last else None))
    return spark.createDataFrame(rows, "id string, name string, status string, batch_id bigint")


def stop_all(spark: SparkSession) -> None:
    """Stop every active query of the session."""
    for query in spark.streams.active:
        query.stop()
