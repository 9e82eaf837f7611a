"""A segmented log as a Spark data source, and a table that takes each batch once.

``segment_log`` holds records of any columns in partitions, each a sequence of offsets, in segments of Parquet files with an
index of their offset and time ranges.  As a stream its offsets are one number a partition, so a query that is restarted from
its checkpoint goes on where it stopped; as a batch it replays a range of offsets or times and opens only the segments that
the range touches.  What ``append`` has not yet entered into the index is never read.

``batch_table`` is a sink with commit: tasks write files of their own, and a batch counts once its manifest is in place,
which happens by one rename.  The first commit of a batch number stands: files of a batch that is written again, or that
fails, are removed.  Reading lists the manifests, so files of lost tasks are never seen; ``sweep`` removes them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, DataSourceArrowWriter, InputPartition, WriterCommitMessage

PARTITIONS, SEGMENT_ROWS = 4, 1 << 20
ROWS = 4096


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _millis(time_col: str):
    return F.unix_millis(F.col(time_col).cast("timestamp"))


def append(rows: DataFrame, path: str, order: list[str], time_col: str | None = None, key: str | None = None, partitions: int = PARTITIONS, segment_rows: int = SEGMENT_ROWS) -> None:
    """Appends rows to a log: partition by a hash of ``key`` (all of ``order`` if there is none), offsets in ``order``.

    Ranges of the order, about ``segment_rows`` rows of each partition, become segments side by side.  A row's offset is its
    place in its segment after the rows of the segments before; the index keeps where each begins.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    ms = _millis(time_col) if time_col else F.lit(0).cast("long")
    lane = F.pmod(F.xxhash64(*[F.col(c) for c in ([key] if key else order)]), F.lit(partitions)).cast("int")
    slices = max(1, -(-rows.count() // (segment_rows * partitions)))
    cut = rows.repartitionByRange(slices, *order).withColumns({"__ms": ms, "__partition": lane, "__slice": F.spark_partition_id()})
    cut.sortWithinPartitions("__partition", "__slice", *order).write.partitionBy("__partition", "__slice").parquet(f"{path}/records/{run}")
    records = spark.read.schema("__ms long, __partition int, __slice int").parquet(f"{path}/records/{run}")
    sizes = records.groupBy(F.col("__partition").alias("partition"), F.col("__slice").alias("slice")).agg(F.count("*").alias("n"), F.min("__ms").alias("first_ms"), F.max("__ms").alias("last_ms"))  # one row a segment
    ends = _index_table(spark, path).groupBy("partition").agg(F.max("stop").alias("begun"))
    before = Window.partitionBy("partition").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.join(ends, "partition", "left").withColumn("first", F.coalesce("begun", F.lit(0)) + F.coalesce(F.sum("n").over(before), F.lit(0)))
    index = sizes.select("partition", "slice", "first", (F.col("first") + F.col("n")).alias("stop"), "first_ms", "last_ms", F.lit(run).alias("run"))
    index.coalesce(1).write.mode("append").parquet(f"{path}/index")  # one file, so it is there as a whole or not


_INDEX = "partition int, slice int, first long, stop long, first_ms long, last_ms long, run string"


def _index_table(spark: SparkSession, path: str) -> DataFrame:
    from pyarrow import fs

    store, root = _store(path)
    if store.get_file_info(f"{root}/index").type == fs.FileType.NotFound:
        return spark.createDataFrame([], _INDEX)
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


@dataclass
class Piece(InputPartition):
    """Offsets start to stop of one segment, and the times asked for."""

    folder: str
    partition: int
    first: int
    start: int
    stop: int
    from_ms: int | None = None
    to_ms: int | None = None


class _Log:
    def __init__(self, options, schema):
        self.path, self.schema = options["path"], schema
        self.options = {k.lower(): v for k, v in options.items()}

    def index(self) -> list[dict]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(f"{root}/index").type == fs.FileType.NotFound:
            return []
        files = [i.path for i in store.get_file_info(fs.FileSelector(f"{root}/index")) if i.path.endswith(".parquet")]
        return sorted((r for f in files for r in pq.read_table(f, filesystem=store).to_pylist()), key=lambda r: (r["partition"], r["first"]))

    def pieces(self, start: dict, end: dict, from_ms: int | None = None, to_ms: int | None = None) -> list[Piece]:
        out = []
        for r in self.index():
            p = str(r["partition"])
            lo, hi = max(r["first"], start.get(p, 0)), min(r["stop"], end.get(p, r["stop"]))
            if lo < hi and (from_ms is None or r["last_ms"] >= from_ms) and (to_ms is None or r["first_ms"] <= to_ms):
                out.append(Piece(f"{self.path}/records/{r['run']}/__partition={p}/__slice={r['slice']}", r["partition"], r["first"], lo, hi, from_ms, to_ms))
        return out

    def rows(self, piece: Piece) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        store, root = _store(piece.folder)
        kind, at = to_arrow_schema(self.schema), piece.first
        for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):  # one file, more if Spark cuts files by rows
            if not info.path.endswith(".parquet"):
                continue
            with store.open_input_file(info.path) as f:
                for b in pq.ParquetFile(f).iter_batches(ROWS):
                    offset = pa.array(range(at, at + len(b)), pa.int64())
                    at += len(b)
                    fits = pc.and_(pc.greater_equal(offset, piece.start), pc.less(offset, piece.stop))
                    ms = b.column(b.schema.get_field_index("__ms"))
                    for bound, test in ((piece.from_ms, pc.greater_equal), (piece.to_ms, pc.less_equal)):
                        if bound is not None:
                            fits = pc.and_(fits, test(ms, bound))
                    own = {"partition": pa.array([piece.partition] * len(b), pa.int32()), "offset": offset}
                    cols = [(own[f.name] if f.name in own else b.column(b.schema.get_field_index(f.name)).cast(f.type)).filter(fits) for f in kind]
                    if cols and len(cols[0]):
                        yield pa.RecordBatch.from_arrays(cols, schema=kind)


class LogStream(_Log, DataSourceStreamReader):
    """Everything between the offsets of two micro-batches; starts at option startingOffsets (JSON by partition) or at the beginning."""

    def initialOffset(self) -> dict:
        start = json.loads(self.options.get("startingoffsets", "{}"))
        return {str(p): start.get(str(p), 0) for p in range(int(self.options.get("partitions", PARTITIONS)))}

    def latestOffset(self) -> dict:
        end = self.initialOffset()
        for r in self.index():
            end[str(r["partition"])] = max(end.get(str(r["partition"]), 0), r["stop"])
        return end

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.pieces(start, end)

    def read(self, partition: Piece) -> Iterator:
        return self.rows(partition)


class LogRange(_Log, DataSourceReader):
    """A range: options startingOffsets and endingOffsets (JSON by partition, the end left out), startingMillis and endingMillis (both included)."""

    def partitions(self) -> list[Piece]:
        offsets = [json.loads(self.options.get(o, "{}")) for o in ("startingoffsets", "endingoffsets")]
        times = [int(self.options[o]) if o in self.options else None for o in ("startingmillis", "endingmillis")]
        return self.pieces(*offsets, *times)

    def read(self, partition: Piece | None) -> Iterator:
        return iter(()) if partition is None else self.rows(partition)


class SegmentLog(DataSource):
    """Options: path, columns (DDL of the records; ``partition int`` and ``offset long`` in it are the log's own, also where records have such columns)."""

    @classmethod
    def name(cls) -> str:
        return "segment_log"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> LogRange:
        return LogRange(self.options, schema)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options, schema)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class _Writer:
    def __init__(self, options):
        self.path, self.attempts = options["path"], int(options.get("attempts", 3))

    def _again(self, call: Callable):
        for n in range(self.attempts):
            try:
                return call()
            except OSError:
                if n + 1 == self.attempts:
                    raise
                time.sleep(0.1 * 2**n)

    def write(self, iterator) -> Written:
        import pyarrow.parquet as pq

        store, root = _store(self.path)
        name, out, n = f"{uuid.uuid4().hex}.parquet", None, 0
        store.create_dir(f"{root}/files")
        try:
            for b in iterator:
                if out is None:
                    out = pq.ParquetWriter(f"{root}/files/{name}", b.schema, filesystem=store)
                self._again(lambda b=b: out.write_batch(b))
                n += len(b)
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(f"{root}/files/{name}")
            raise
        if out is not None:
            out.close()
        return Written(name if out is not None else None, n)

    def _drop(self, messages) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m is not None and m.file is not None:
                store.delete_file(f"{root}/files/{m.file}")

    def _commit(self, messages, batch: int) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        store.create_dir(f"{root}/manifests")
        place = f"{root}/manifests/{batch:020d}.json"
        if store.get_file_info(place).type != fs.FileType.NotFound:
            self._drop(messages)
            return
        staged = f"{root}/manifests/_{uuid.uuid4().hex}"
        with store.open_output_stream(staged) as f:
            f.write(json.dumps({"batch": batch, "files": [m.file for m in messages if m is not None and m.file], "rows": sum(m.rows for m in messages if m is not None)}).encode())
        self._again(lambda: store.move(staged, place))


class StreamSink(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages, batchId: int) -> None:
        self._drop(messages)


class BatchSink(_Writer, DataSourceArrowWriter):
    def __init__(self, options):
        super().__init__(options)
        self.batch = int(options["batch"])

    def commit(self, messages) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages) -> None:
        self._drop(messages)


@dataclass
class Held(InputPartition):
    file: str
    batch: int


class TableReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.kind = options["path"], schema

    def partitions(self) -> list[Held]:
        from pyarrow import fs

        store, root = _store(self.path)
        out = []
        for info in store.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True)):
            if info.path.endswith(".json"):
                with store.open_input_stream(info.path) as f:
                    found = json.loads(f.read())
                out += [Held(f"{root}/files/{name}", found["batch"]) for name in found["files"]]
        return out

    def read(self, partition: Held | None) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:
            return
        kind = to_arrow_schema(self.kind)
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as f:
            for b in pq.ParquetFile(f).iter_batches(ROWS):
                cols = [pa.array([partition.batch] * len(b), pa.int64()) if f.name == "batch" else b.column(b.schema.get_field_index(f.name)).cast(f.type) for f in kind]
                yield pa.RecordBatch.from_arrays(cols, schema=kind)


def sweep(path: str, older_s: float = 86_400) -> int:
    """Removes files of a batch_table that no manifest names and that are older than any running write: what lost tasks left."""
    from pyarrow import fs

    store, root = _store(path)
    named = {h.file for h in TableReader({"path": path}, None).partitions()}
    found = store.get_file_info(fs.FileSelector(f"{root}/files", allow_not_found=True))
    lost = [i.path for i in found if i.path not in named and i.mtime.timestamp() <= time.time() - older_s]
    for f in lost:
        store.delete_file(f)
    return len(lost)


class BatchTable(DataSource):
    """Options: path; columns to read (DDL; batch long may be among them); batch, the number of a batch write; attempts."""

    @classmethod
    def name(cls) -> str:
        return "batch_table"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> TableReader:
        return TableReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> BatchSink:
        return BatchSink(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamSink:
        return StreamSink(self.options)


def registered(spark: SparkSession) -> SparkSession:
    for source in (SegmentLog, BatchTable):
        spark.dataSource.register(source)
    return spark


def ddl(df: DataFrame, *more: str) -> str:
    """The columns of df as DDL."""
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *more])


def stream(spark: SparkSession, path: str, columns: str, **options) -> DataFrame:
    return registered(spark).readStream.format("segment_log").options(path=path, columns=columns, **options).load()


def replay(spark: SparkSession, path: str, columns: str, **options) -> DataFrame:
    return registered(spark).read.format("segment_log").options(path=path, columns=columns, **options).load()


def put(df: DataFrame, path: str, batch: int) -> None:
    """Writes df as a batch of a table; again under the same number, it changes nothing."""
    registered(df.sparkSession)
    df.write.format("batch_table").mode("append").options(path=path, batch=batch).save()


def got(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return registered(spark).read.format("batch_table").options(path=path, columns=columns).load()
