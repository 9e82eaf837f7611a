"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_LITERAL = r"[^\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once inside a higher-order function (element_at keeps its type; get derives it for every row)."""
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or in local mode a temporary one where that is unset.  On a cluster it must be set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/quarry"


def known_to_arrow(path: str) -> bool:
    """Whether tasks can open this path through Arrow's file systems."""
    from pyarrow import ArrowInvalid, ArrowNotImplementedError, fs

    try:
        fs.FileSystem.from_uri(path)
    except (ArrowInvalid, ArrowNotImplementedError, OSError):
        return False
    return True


class Own:
    """A table whose own columns can't clash with an operator's: they are renamed by position (own_0, own_1, ...), whatever they are called and hold.

    keep: the names of the columns to give back (all); those named like a result, in any case, are left to the result.
    """

    def __init__(self, df: DataFrame, keep: list[str] | None = None, results: tuple[str, ...] | list[str] = ()):
        self.names = df.columns
        self.rows = df.toDF(*[f"own_{i}" for i in range(len(self.names))])
        taken = {r.lower() for r in results}
        places = range(len(self.names)) if keep is None else [self._place(c) for c in keep]
        self.kept = [i for i in places if self.names[i].lower() not in taken]

    def _place(self, name: str) -> int:
        if name in self.names:
            return self.names.index(name)
        return [n.lower() for n in self.names].index(name.lower())

    def name(self, name: str) -> str:
        """A column's inner name."""
        return f"own_{self._place(name)}"

    def at(self, name: str) -> Column:
        return F.col(self.name(name))

    @property
    def columns(self) -> list[str]:
        """The kept columns under their inner names."""
        return [f"own_{i}" for i in self.kept]

    def restored(self, df: DataFrame, *results) -> DataFrame:
        """df's kept columns under their own names, then results."""
        return df.select(*[F.col(f"own_{i}").alias(self.names[i]) for i in self.kept], *results)


@contextmanager
def arrow_batches(spark: SparkSession, size: str = "8m"):
    """Within it, what runs (not what is only planned) hands Python at most about so much at a time; the setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lean() -> None:
    """In a task: Arrow hands freed memory back to the system, unlike its pooling default."""
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())


def written(df: DataFrame, **options) -> tuple[DataFrame, str]:
    """df written as Parquet (options: the writer's) in the shared folder and read again, and where it lies: cuts lineage at the cost of one run (checkpoint() runs its plan twice)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that written() made."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _settled(edges: DataFrame):
    return edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, root), root the smallest node of the component; nodes without edges are absent.

    Alternating large-star and small-star passes; each pass is joins and partial aggregates over the edges, written to the
    shared folder, so no component is ever gathered in one task.  Rounds grow with the logarithm of the diameter.
    """
    spark = edges.sparkSession
    e, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _settled(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are plain shuffles and the edges of a node with very many can be split over tasks
        least, least_path = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # written, so that neither side of the next join is an aggregate by its key and a hub's edges can be split over tasks
        large, large_path = written(large)
        low, low_path = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, new = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        removed(spark, path)
        for p in (least_path, large_path, low_path):
            removed(spark, p)
        path = new
        state, before = _settled(e), state
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
