"""Steps with state by key, in Spark's own state store (transformWithState over RocksDB)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that start, and state that is read, within it use the state store that these steps need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Accumulate(StatefulProcessor):
    """Groups of ``size`` rows of a key fire at once; fewer wait, and fire when the key had no rows for ``idle_ms``.

    State is the waiting rows, below ``size`` a key, and one timer; keys without waiting rows hold none.
    """

    def __init__(self, keys: list[str], row: T.StructType, size: int, idle_ms: int):
        self.keys, self.row, self.size, self.idle = keys, row, size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.row)

    def _group(self, key: tuple, part: str, rows: list[tuple]) -> Row:
        one = Row(*self.row.names)
        return Row(*self.keys, "part", "rows")(*key, part, [one(*r) for r in rows])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting, names = list(self.held.get()), self.row.names
        for r in rows:
            waiting.append(tuple(r[n] for n in names))
            if len(waiting) == self.size:
                yield self._group(key, "full", waiting)
                waiting = []
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if waiting:
            self.held.put([tuple(r) for r in waiting])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting = list(self.held.get())
        self.held.clear()
        if waiting:
            yield self._group(key, "idle", waiting)


def accumulated(stream: DataFrame, keys: list[str], size: int, idle_ms: int) -> DataFrame:
    """(keys..., part, rows): groups as Accumulate fires them, with all columns of their rows."""
    row = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    out = T.StructType([*[stream.schema[k] for k in keys], T.StructField("part", T.StringType()), T.StructField("rows", T.ArrayType(row))])
    return stream.groupBy(*keys).transformWithState(Accumulate(keys, row, size, idle_ms), out, "Append", "ProcessingTime")


def waiting(spark: SparkSession, checkpoint: str, state: str = "held") -> DataFrame:
    """(key, row) of what a stopped query still holds, read from its state: the flush at shutdown.

    A stream that is flushed so starts anew from the offsets it ended at; one that goes on from its checkpoint fires these rows itself.
    """
    with rocksdb(spark):
        found = spark.read.format("statestore").option("stateVarName", state).load(checkpoint)
        return found.select("key", F.col("list_element").alias("row"))


class Completion(StatefulProcessor):
    """Counts of a key until it is final and all that was produced has been received; then it is named once."""

    def __init__(self, key: T.StructField):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "produced long, received long, finalised boolean, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        produced, received, final, done = self.counts.get() or (0, 0, False, False)
        for r in rows:
            produced, received, final = produced + (r["produced"] or 0), received + (r["received"] or 0), final or bool(r["finalised"])
        if final and received >= produced and not done:
            done = True
            yield Row(self.key.name, "produced", "received")(*key, produced, received)
        self.counts.update((produced, received, final, done))


def completed(stream: DataFrame, key: str) -> DataFrame:
    """(key, produced, received) of each run once."""
    out = T.StructType([stream.schema[key], T.StructField("produced", T.LongType()), T.StructField("received", T.LongType())])
    return stream.groupBy(key).transformWithState(Completion(stream.schema[key]), out, "Append", "None")


class LateNodes(StatefulProcessor):
    """Edges of a node wait until it is there; each is given out once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "known boolean")
        self.edges = handle.getMapState("edges", "dst string", "given boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.known.exists()
        fresh = known
        for r in rows:
            if r["kind"] == "node":
                known = True
            elif r["kind"] == "edge" and not self.edges.containsKey((r["dst"],)):
                if fresh:
                    yield Row(src=key[0], dst=r["dst"])
                self.edges.updateValue((r["dst"],), (fresh,))
        if known and not fresh:
            self.known.update((True,))
            for dst, given in [(k, v) for k, v in self.edges.iterator()]:
                if not given[0]:
                    self.edges.updateValue(dst, (True,))
                    yield Row(src=key[0], dst=dst[0])


def edges_with_nodes(stream: DataFrame) -> DataFrame:
    """(src, dst) of a stream of (kind node|edge, src, dst), each edge once its node is there, however late."""
    return stream.groupBy("src").transformWithState(LateNodes(), "src string, dst string", "Append", "None")
