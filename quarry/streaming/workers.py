"""The workers of the ingestion pipeline as streams: sources, sinks, and steps.

State is Spark's own (deduplication, aggregates, and keyed.py), offsets are those of the source, and each batch's rows are
committed once under its number, so a query that is stopped anywhere goes on from its checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upserts
from ..operators.clusters import kept_dir
from ..sources import log
from . import keyed


def source(spark: SparkSession, fmt: str, options: dict[str, str], schema: str | None = None, per_trigger: int = 100) -> DataFrame:
    """A stream of records: Kafka topics where the connector is on the class path, else a folder of files, a bounded number a trigger."""
    reader = spark.readStream.format(fmt).option("maxOffsetsPerTrigger" if fmt == "kafka" else "maxFilesPerTrigger", per_trigger)
    for k, v in options.items():
        reader = reader.option(k, v)
    return (reader if schema is None else reader.schema(schema)).load()


def decoded(messages: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """The fields of JSON messages; those that are none are left out."""
    return messages.select("*", F.from_json(F.col(value).cast("string"), schema).alias("__m")).where(F.col("__m").isNotNull()).select(*[c for c in messages.columns if c != value], "__m.*")


def item_kind(topic: Column) -> Column:
    """What the messages of a topic are, by its name."""
    out = F.when(F.lit(False), "")
    for word, kind in (("summar", "summary"), ("entit", "entity"), ("chunk", "chunk")):
        out = out.when(F.contains(topic, F.lit(word)), kind)
    return out


def messages(rows: DataFrame, topic: str, key: str) -> DataFrame:
    """rows as (topic, key, value) messages, as a Kafka sink takes them."""
    return rows.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


class Job:
    """A streaming query that is run, stopped and run again from its checkpoint.

    make() gives the stream of results.  Appended rows go into a batch_table, each batch once; with ``update`` every batch
    brings the rows of the keys that it changed, so what is written grows with the changes and not with the table.
    """

    def __init__(self, spark: SparkSession, make: Callable[[], DataFrame], place: str | None = None, update: bool = False):
        self.spark, self.make, self.update = spark, make, update
        self.place = place or f"{kept_dir(spark)}/quarry-job-{uuid.uuid4().hex}"
        self.checkpoint, self.table = f"{self.place}/offsets", f"{self.place}/table"
        self.columns: str | None = None

    def start(self, **trigger):
        """The running query; the trigger is all that is there now unless another is given."""
        log.registered(self.spark)
        with keyed.rocksdb(self.spark):
            out = self.make()
            self.columns = log.ddl(out)
            writer = out.writeStream.option("checkpointLocation", self.checkpoint).trigger(**(trigger or {"availableNow": True}))
            if self.update:
                table = self.table
                return writer.outputMode("update").foreachBatch(lambda batch, nr: log.put(batch, table, nr)).start()
            return writer.outputMode("append").format("batch_table").option("path", self.table).start()

    def run(self) -> None:
        """All that is there now."""
        self.start().awaitTermination()

    def rows(self) -> DataFrame:
        """What the batches so far have written, with the number of their batch."""
        return log.got(self.spark, self.table, f"{self.columns}, batch long")

    def latest(self, *keys: str) -> DataFrame:
        """The last row that was written for each key."""
        rows = self.rows()
        own = [c for c in rows.columns if c != "batch"]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "batch").alias("__row")).select("__row.*")


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """step for each micro-batch of all that is there now; it may be called again with the same number and must then do the same."""
    stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def new_content(stream: DataFrame) -> DataFrame:
    """Rows (item_id, stage, content_hash, ...) whose hash has not come before for their item and stage; state is one entry each."""
    return stream.dropDuplicates(["item_id", "stage", "content_hash"])


def changes_applied(stream: DataFrame, key: str = "entity_id", order: str = "offset") -> DataFrame:
    """The last create, update or delete event of each key, whatever batches they come in; for an update job.  Deletions stay as marks."""
    known = stream.where(F.col("action").isin("create", "update", "delete"))
    return known.groupBy(key).agg(F.max(F.struct(order, *[c for c in stream.columns if c not in (key, order)])).alias("last")).select(key, "last.*")


def last_by_window(stream: DataFrame, key: str, value: str, time: str, size: str, late: str = "1 minute") -> DataFrame:
    """(start, key, value): the last value of each key in each tumbling window, for an update job; windows beyond the watermark leave the state."""
    last = stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.max(F.struct(time, value)).alias("last"))
    return last.select(F.col("w.start").alias("start"), key, F.col(f"last.{value}").alias(value))


def sized_batches(stream: DataFrame, lane: Column, size: int = 100, idle_ms: int = 500) -> DataFrame:
    """(lane, part, rows): batches of ``size`` rows, or fewer once a lane had none for ``idle_ms``."""
    return keyed.accumulated(stream.withColumn("lane", lane), ["lane"], size, idle_ms)


def deletes_first(target: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The target after a batch of (key, action, offset, ...): its deletions first, then the last of its other events of each key."""
    gone = batch.where("action = 'delete'").select(key).distinct()
    new = upserts.latest(batch.where("action <> 'delete'"), [key], [order]).select(*target.columns)
    return target.join(gone, key, "left_anti").join(new.select(key), key, "left_anti").unionByName(new)


def once_within(stream: DataFrame, key: str, time: str, ttl: str) -> DataFrame:
    """The first row of each key within the time to live; rows without a key all stay."""
    named = stream.where(F.col(key).isNotNull()).withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])
    return named.unionByName(stream.where(F.col(key).isNull()).withWatermark(time, ttl))


def with_retries(rows: DataFrame, call: Callable, attempts: int = 3, base_s: float = 0.0) -> DataFrame:
    """rows (id, text) sent through ``call(text, attempt)`` with growing pauses: (id, attempts, result, error); rows that fail every time keep their last error."""

    def send(batches):
        import time

        import pandas as pd

        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"]):
                result = error = None
                for n in range(1, attempts + 1):
                    try:
                        result, error = call(text, n), None
                        break
                    except Exception as e:  # noqa: BLE001  (whatever a provider raises is recorded)
                        error = str(e)
                        time.sleep(base_s * 2 ** (n - 1))
                out.append((i, n, result, error))
            yield pd.DataFrame(out, columns=["id", "attempts", "result", "error"])

    return rows.select("id", "text").mapInPandas(send, "id long, attempts int, result string, error string")
