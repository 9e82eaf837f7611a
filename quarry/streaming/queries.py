"""Structured Streaming forms of the workers: the batch functions behind foreachBatch, and stateful deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import upserts


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100, fmt: str = "json") -> DataFrame:
    """A folder as a stream, a bounded number of files a trigger."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def once_per_event(events: DataFrame, id_col: str = "event_id", time: str = "ts", within: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([id_col])


def last_in_window(events: DataFrame, key: str, value: str, time: str = "ts", size: str = "60 seconds", late: str = "1 minute") -> DataFrame:
    """The last value of each key in each tumbling window."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.max_by(value, time).alias(value))


def complete_runs(counters: DataFrame, key: str = "ingestion_id") -> DataFrame:
    """Runs for which every upstream total was received: state is one row a run."""
    by = counters.groupBy(key).agg(F.sum("produced").alias("produced"), F.sum("received").alias("received"), F.bool_and("finalised").alias("finalised"))
    return by.where("finalised and received >= produced")


def apply_changes(target: DataFrame, changes: DataFrame, key: str = "entity_id", order: str = "offset") -> DataFrame:
    """Create, update and delete events, the last of each key in offset order; unknown actions and unchanged content are skipped."""
    last = upserts.latest(changes.where(F.col("action").isin("create", "update", "delete")), [key], [order])
    kept = target.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("action <> 'delete'").select(*target.columns))


def unchanged_removed(rows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Rows whose content hash isn't stored for their (item_id, stage)."""
    return rows.join(checkpoints.select("item_id", "stage", "content_hash"), ["item_id", "stage", "content_hash"], "left_anti")


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """step for each micro-batch; offsets are committed after it, so it must be idempotent by batch id or key."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
