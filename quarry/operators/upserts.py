"""Keyed writes as rewrites of DataFrames: latest wins, merges, counters, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__nr", F.row_number().over(w)).where("__nr = 1").drop("__nr")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Target with the latest update of each key in place of its row."""
    new = latest(updates, keys, order)
    return target.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_nodes(target: DataFrame, updates: DataFrame, key: str, on_match: list[str], created: str = "created_at") -> DataFrame:
    """MERGE by id: new rows take all columns, known rows only those in on_match."""
    u = updates.select(*[F.col(c).alias(f"u_{c}") for c in updates.columns])
    joined = target.join(u, F.col(key) == F.col(f"u_{key}"), "full_outer")
    pick = lambda c: F.when(F.col(key).isNull(), F.col(f"u_{c}")).when(F.col(f"u_{key}").isNotNull(), F.coalesce(f"u_{c}", c) if c in on_match else F.col(c)).otherwise(F.col(c))
    return joined.select(*[pick(c).alias(c) for c in target.columns])


def add_counters(counters: DataFrame, deltas: DataFrame, keys: list[str], value: str = "counter_value") -> DataFrame:
    return counters.select(*keys, value).unionByName(deltas.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def set_counters(counters: DataFrame, keys: list[str], value: str = "counter_value", at: str = "updated_at") -> DataFrame:
    return counters.groupBy(*keys).agg(F.max_by(value, at).alias(value))


def record_versions(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes whose content hash is new under their key, numbered on from the key's largest version."""
    fresh = changes.join(stored.select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti")
    last = stored.groupBy(*keys).agg(F.max("version").alias("last"))
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy("content_hash"))
    return fresh.join(last, keys, "left").withColumn("version", F.coalesce("last", F.lit(0)) + nr).drop("last")


def surviving(rows: DataFrame, gone: DataFrame, name: str, file: str) -> DataFrame:
    """Vector survival: rows of deleted files stay if another file names the same thing; nameless ones go."""
    kept = rows.join(gone.select(file), file, "left_anti")
    names = kept.where(F.col(name).isNotNull()).select(name).distinct()
    return kept.unionByName(rows.join(gone.select(file), file, "left_semi").join(names, name, "left_semi").select(*rows.columns))


def merge_edges(target: DataFrame, updates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, rel, dst) with ``what``: those of the target, and each new one once if both ends are nodes."""
    ids = lambda end: nodes.select(F.col("id").alias(end))
    known = updates.select("src", "rel", "dst").distinct().join(ids("src"), "src", "left_semi").join(ids("dst"), "dst", "left_semi")
    new = known.join(target, ["src", "rel", "dst"], "left_anti")
    return target.select("src", "rel", "dst", F.lit("kept").alias("what")).unionByName(new.select("src", "rel", "dst", F.lit("new").alias("what")))


def moved_tenant(rows: DataFrame, key: str, old, new) -> DataFrame:
    """rows with the tenant ``old`` rewritten to ``new``, and whether a row moved."""
    moves = F.coalesce(F.col(key) == old, F.lit(False))
    return rows.withColumn("moved", moves).withColumn(key, F.when(F.col("moved"), F.lit(new)).otherwise(F.col(key)))


def orphans(mentions: DataFrame, alive: DataFrame) -> DataFrame:
    """(entity, chunks): entities of mentions (entity, chunk) none of whose chunks is alive, with how many mentions they lose.

    A chunk that is null or of no table counts as deleted; a mention without entity is of none.
    """
    living = alive.select("chunk").where("chunk is not null").distinct().withColumn("__alive", F.lit(True))
    found = mentions.where("entity is not null").join(living, "chunk", "left")
    return found.groupBy("entity").agg(F.count("*").alias("chunks"), F.count("__alive").alias("__n")).where("__n = 0").select("entity", "chunks")


def integrity(mentions: DataFrame, chunks: DataFrame, typed: DataFrame) -> DataFrame:
    """(finding, id): entities without a chunk that exists, entities without a type, chunks without an entity.

    mentions (entity, chunk), chunks (chunk), typed (entity).  Each finding once; null ids are none.
    ids keep their type where entities and chunks have the same, and are strings otherwise.
    """
    met = mentions.where("entity is not null").select("entity", "chunk").distinct()
    chunks = chunks.where("chunk is not null").select("chunk").distinct()
    entities = met.select("entity").distinct()
    same = met.schema["entity"].dataType == chunks.schema["chunk"].dataType
    said = lambda df, what, key: df.select(F.lit(what).alias("finding"), (F.col(key) if same else F.col(key).cast("string")).alias("id"))
    held = met.join(chunks, "chunk", "left_semi").select("entity")
    out = said(entities.join(held, "entity", "left_anti"), "orphan_entity", "entity")
    out = out.unionByName(said(entities.join(typed, "entity", "left_anti"), "untyped_entity", "entity"))
    return out.unionByName(said(chunks.join(met, "chunk", "left_anti"), "empty_chunk", "chunk"))
