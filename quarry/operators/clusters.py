"""Entities that are one: fuzzy pairs by blocking, clusters, and merges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical as cn

#: Lengths of the beginnings by which a name finds those that hold it.
GRAMS = (1, 2, 4, 8, 16)


def kept_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a temporary folder where that is unset, an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/quarry"


def kept(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read again, which cuts its lineage."""
    path = f"{kept_dir(df.sparkSession)}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def names_that_meet(names: DataFrame) -> DataFrame:
    """Pairs (entity_type, a, b), a < b, of different normalised names (entity_type, norm) of which one may hold the other or that are within MAX_EDITS edits.

    No pair is lost: a name that another holds begins with one of its substrings of a length in GRAMS, and of names within two
    edits one has a third that the other has too, shifted by two places at most.  Only those blocks are joined.
    """
    n = names.withColumn("len", F.length("norm"))
    least = F.lit(GRAMS[0])
    for g in GRAMS[1:]:
        least = F.when(F.col("len") >= g, g).otherwise(least)
    begins = n.where("len > 0").select("entity_type", F.col("norm").alias("a"), F.substring("norm", F.lit(1), least).alias("gram"))
    none = F.array().cast("array<string>")
    cut = lambda g: F.when(F.col("len") >= g, F.transform(F.sequence(F.lit(1), F.col("len") - g + 1), lambda i: F.substring("norm", i, F.lit(g)))).otherwise(none)
    cuts = F.flatten(F.array(*[cut(g) for g in GRAMS]))
    holds = n.where("len > 0").select("entity_type", F.col("norm").alias("b"), F.explode(F.array_distinct(cuts)).alias("gram"))
    within = begins.join(holds, ["entity_type", "gram"]).where("a <> b and contains(b, a)").select("entity_type", "a", "b")
    # thirds of a name of length m begin at floor(i * m / 3)
    edge = lambda m, i: F.floor(m * i / 3).cast("int")
    parts = cn.MAX_EDITS + 1
    third = lambda m, i, at: F.struct(m.alias("m"), i.alias("i"), F.substring("norm", at + 1, edge(m, i + 1) - edge(m, i)).alias("piece"))
    own = n.select("entity_type", F.col("norm").alias("a"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: third(F.col("len"), i, edge(F.col("len"), i)))).alias("p"))
    near = F.array(*[F.lit(d) for d in range(-cn.MAX_EDITS, cn.MAX_EDITS + 1)])
    lengths = F.filter(F.transform(near, lambda d: F.col("len") + d), lambda m: m >= 0)
    seen = F.flatten(F.transform(lengths, lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.transform(F.filter(F.transform(near, lambda d: edge(m, i) + d), lambda at: at >= 0), lambda at: third(m, i, at))))))
    other = n.select("entity_type", F.col("norm").alias("b"), F.explode(F.array_distinct(seen)).alias("p"))
    edits = own.join(other, ["entity_type", "p"]).where(F.col("a") != F.col("b")).where(F.levenshtein("a", "b", cn.MAX_EDITS) >= 0).select("entity_type", "a", "b")
    return within.unionByName(edits).select("entity_type", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fuzzy_pairs(entities: DataFrame) -> DataFrame:
    """(entity_type, a, b, reason): pairs a < b of different names of entities (entity_type, name, description) that are one.

    Entities of one type and name are one already, with the least of their descriptions.  Names of one normal form meet by it.
    """
    e = entities.where("entity_type <> '' and name <> ''").groupBy("entity_type", "name").agg(F.min("description").alias("description")).withColumn("norm", cn.normalised(F.col("name")))
    met = names_that_meet(e.select("entity_type", "norm").distinct())
    met = met.unionByName(e.select("entity_type", F.col("norm").alias("a"), F.col("norm").alias("b")).distinct())
    side = lambda x: e.select("entity_type", F.col("norm").alias(x), F.struct("name", "description", F.array().cast("array<string>").alias("aliases")).alias(f"__{x}"))
    pairs = met.join(side("a"), ["entity_type", "a"]).join(side("b"), ["entity_type", "b"])
    # a pair of normal forms is unordered, names are
    x, y = F.col("__a"), F.col("__b")
    pairs = pairs.select("entity_type", F.when(x["name"] < y["name"], x).otherwise(y).alias("x"), F.when(x["name"] < y["name"], y).otherwise(x).alias("y")).where("x.name <> y.name").distinct()
    return pairs.select("entity_type", F.col("x.name").alias("a"), F.col("y.name").alias("b"), cn.match_reason(F.col("x"), F.col("y")).alias("reason")).where("reason is not null")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b): root is the smallest node reachable.  Each round takes the least neighbour, then the least neighbour's own least; rounds grow with the logarithm of the diameter."""
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    roots, before = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))), None
    while True:
        of = lambda x, y: roots.select(F.col("node").alias(x), F.col("root").alias(y))
        hop = both.join(of("b", "r"), "b").groupBy("a").agg(F.min("r").alias("r"))
        found = roots.join(hop.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "r").alias("root"))
        jump = found.select(F.col("node").alias("root"), F.col("root").alias("up"))
        roots = kept(found.join(jump, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root")))
        now = roots.agg(F.expr("bit_xor(xxhash64(node, root))"), F.count("*")).first()
        if now == before:
            return roots
        before = now


def clusters(entities: DataFrame) -> DataFrame:
    """(entity_type, name, cluster) of every distinct name; cluster is the least name of the cluster."""
    names = entities.where("entity_type <> '' and name <> ''").select("entity_type", "name").distinct()
    key = lambda c: F.struct("entity_type", F.col(c).alias("name"))
    roots = components(fuzzy_pairs(entities).select(key("a").alias("a"), key("b").alias("b")))
    roots = roots.select(F.col("node.entity_type").alias("entity_type"), F.col("node.name").alias("name"), F.col("root.name").alias("cluster"))
    return names.join(roots, ["entity_type", "name"], "left").withColumn("cluster", F.coalesce("cluster", "name"))


def merges(entities: DataFrame) -> DataFrame:
    """(entity_type, duplicate, canonical): the names that go, and the one of their cluster that stays; names that differ by a tier or number from it stay too."""
    best = Window.partitionBy("entity_type", "cluster").orderBy(cn.canonical_score(F.col("name")).desc(), "name")
    found = clusters(entities).withColumn("canonical", F.first("name").over(best)).where("name <> canonical")
    return found.where(~F.coalesce(cn.merge_blocked(F.col("canonical"), F.col("name")), F.lit(False))).select("entity_type", F.col("name").alias("duplicate"), "canonical")
