"""Composite searches: levels, sweeps, modes, and triplets around hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors

# --- fixed values ---
#: (top_k, wide_top_k) by depth.
DEPTHS = (("concise", 10, 100), ("standard", 20, 200), ("thorough", 30, 300))
DEFAULT_DEPTH = "thorough"
MODES = ("GRAPH_COMPLETION", "TRIPLET_COMPLETION", "CHUNKS", "RAG_COMPLETION", "SUMMARIES", "GRAPH_SUMMARY_COMPLETION", "CYPHER", "NATURAL_LANGUAGE", "GRAPH_COMPLETION_COT", "GRAPH_COMPLETION_CONTEXT_EXTENSION", "FEELING_LUCKY", "TEMPORAL", "CODING_RULES", "CHUNKS_LEXICAL")
ADMIN_MODES = ("CYPHER", "NATURAL_LANGUAGE")
DEFAULT_MODE = "GRAPH_COMPLETION"
# --- end of fixed values ---


def full_search(depth: int, domains: Callable[[], DataFrame], entities: Callable[[], DataFrame], summaries: Callable[[], DataFrame], code_of: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The levels up to ``depth`` (0 to 3); the last is the code of the first entity found, found by a join with that one row."""
    found = {"domains": domains()}
    if depth >= 1:
        found["entities"] = entities()
    if depth >= 2:
        found["summaries"] = summaries()
    if depth >= 3:
        found["code"] = code_of(found["entities"].limit(1))
    return found


def levels(found: dict[str, DataFrame]) -> DataFrame:
    """(level, id, value) of several results (id, value)."""
    out = None
    for name, df in found.items():
        part = df.select(F.lit(name).alias("level"), F.col("id").cast("string").alias("id"), F.col("value").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def search_in_mode(mode: str, searches: dict[str, Callable[[], DataFrame]], admin: bool = False) -> DataFrame:
    """The search of a mode, that of the default mode where it is unknown; some modes are the administrators' only."""
    mode = mode if mode in MODES else DEFAULT_MODE
    if mode in ADMIN_MODES and not admin:
        raise PermissionError(f"{mode} is for administrators")
    return searches[mode]()


def depth_preset(depth: Column, top_k: Column, wide: Column) -> Column:
    """struct(top_k, wide_top_k): the preset of a depth (the default one where unknown), own numbers before it unless null or zero."""
    name = F.lower(F.trim(F.coalesce(depth, F.lit(""))))
    names = [n for n, _, _ in DEPTHS]
    name = F.when(name.isin(*names), name).otherwise(DEFAULT_DEPTH)

    def preset(i: int) -> Column:
        out = F.lit(None)
        for row in DEPTHS:
            out = F.when(name == row[0], row[i]).otherwise(out)
        return out

    own = lambda c: F.nullif(c.cast("int"), F.lit(0))
    return F.struct(F.coalesce(own(top_k), preset(1)).alias("top_k"), F.coalesce(own(wide), preset(2)).alias("wide_top_k"))


def scoped_triplets(hits: dict[str, DataFrame], edges: DataFrame, k: int, touches: Column, penalty: float = 3.5) -> DataFrame:
    """The best k triplets among the edges (src, rel, dst) with both ends among the hits (id, distance) of any collection, each bounded by its own search."""
    near = None
    for df in hits.values():
        part = df.select("id", "distance")
        near = part if near is None else near.unionByName(part)
    near = near.groupBy("id").agg(F.min("distance").alias("distance"))
    ids = lambda end: near.select(F.col("id").alias(end))
    inside = edges.join(ids("src"), "src", "left_semi").join(ids("dst"), "dst", "left_semi").select("src", "rel", "dst").distinct()
    return vectors.triplet_importance(inside, near, k, touches, penalty)


def ordered_distinct(values: Column, most: int) -> Column:
    """The first ``most`` different non-blank values, trimmed, in their order."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, F.trim), lambda v: v != "")), 1, most)


