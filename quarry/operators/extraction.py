"""Extraction results of a model to entities and edges with deterministic ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids


def payloads(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (chunk_id, entity_id, name, entity_type, description) and edges (chunk_id, source_id, target_id, relationship_type, source_name, target_name).

    From (chunk_id, node_set, nodes array<struct(id, name, type, description)>, edges array<struct(source, target, type)>), one
    row a result, whose size a model's answer bounds.  Edges name nodes by id: the last node of an id counts.  A blank
    description becomes the name; nodes without a name, edges with an unknown end, loops and repeated edges go.
    """
    r = results.select("chunk_id", "node_set", F.filter(F.coalesce("nodes", F.array()), lambda n: F.coalesce(n["name"], F.lit("")) != "").alias("nodes"), "edges")
    name_of = lambda i: F.try_element_at(F.filter("nodes", lambda n: n["id"] == i), F.lit(-1))["name"]
    e = r.select("chunk_id", "node_set", F.explode("nodes").alias("n"))
    said = F.trim(F.regexp_replace(F.coalesce("n.description", F.lit("")), r"^\s+|\s+$", ""))
    entities = e.select("chunk_id", ids.entity_id(F.col("n.name"), F.col("node_set")).alias("entity_id"), "n.name", F.col("n.type").alias("entity_type"), F.when(said == "", F.col("n.name")).otherwise(said).alias("description"))
    named = F.transform("edges", lambda x: F.struct(name_of(x["source"]).alias("source"), name_of(x["target"]).alias("target"), x["type"].alias("type")))
    kept = F.array_distinct(F.filter(named, lambda x: x["source"] != x["target"]))
    d = r.select("chunk_id", "node_set", F.explode(kept).alias("x"))
    end = lambda which: ids.entity_id(F.col(f"x.{which}"), F.col("node_set"))
    edges = d.select("chunk_id", end("source").alias("source_id"), end("target").alias("target_id"), F.col("x.type").alias("relationship_type"), F.col("x.source").alias("source_name"), F.col("x.target").alias("target_name"))
    return entities, edges
