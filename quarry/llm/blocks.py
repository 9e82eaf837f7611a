"""Vectors packed in blocks: what the exact and the approximate search share.

A set of vectors becomes rows of (key columns, ids binary, vectors binary) of bounded size, so that queries meet candidates
in blocks, by an equi-join on a shard number, never row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a block holds at most, about.
SHARD_ROWS = 8192
QUERY_ROWS = 512


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", nonzero: bool = False) -> DataFrame:
    """(id long, vec array<double>) of the rows with an id and a vector that is not null, empty or holding null, NaN or infinity (or all zeros)."""
    inf = float("inf")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)
    vec = F.transform(embedding, lambda x: x.cast("double"))
    out = rows.select(F.col(vec_id).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.coalesce(F.forall("vec", fine), F.lit(False)))
    return out.where(F.exists("vec", lambda x: x != 0)) if nonzero else out


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by ``every``; of rows that share an id, the one with the smallest vector."""
    return rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))


def shards_for(n: int, rows: int) -> int:
    return max(1, -(-n // rows))


def lane(n: int) -> Column:
    """A shard number from 0 below n, the same for the same id."""
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def matrix(pdf):
    """ids and vectors of a pandas frame (id, vec)."""
    import numpy as np

    return pdf["id"].to_numpy(np.int64), np.stack([np.asarray(v, np.float64) for v in pdf["vec"]])


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller id, with rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
