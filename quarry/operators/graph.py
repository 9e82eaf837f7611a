"""Property-graph operators on nodes(id, label, ...) and edges(src, rel, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import kept


def undirected(edges: DataFrame) -> DataFrame:
    """(node, rel, other, outgoing) in both directions."""
    return edges.select(F.col("src").alias("node"), "rel", F.col("dst").alias("other"), F.lit(True).alias("outgoing")).unionByName(edges.select(F.col("dst").alias("node"), "rel", F.col("src").alias("other"), F.lit(False).alias("outgoing")))


def neighbours(edges: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """Up to ``limit`` one-hop neighbours of each start (id), in the order (rel, other): one join, not one query a start."""
    found = undirected(edges).join(starts.select(F.col("id").alias("node")), "node").distinct()
    w = Window.partitionBy("node").orderBy("rel", "other", "outgoing")
    return found.withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= limit)


def paths(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", min_depth: int = 1) -> DataFrame:
    """(start, node, depth, path): every path of up to ``depth`` edges that repeats no edge (nodes may repeat).

    A bounded loop of equi-joins; the edge ids on the path are carried to test repetition.
    """
    if direction == "both":
        steps = undirected(edges).select("node", "other", F.when(F.col("outgoing"), F.concat_ws("|", "node", "rel", "other")).otherwise(F.concat_ws("|", "other", "rel", "node")).alias("edge"))
    else:
        a, b = ("src", "dst") if direction == "out" else ("dst", "src")
        steps = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.concat_ws("|", "src", "rel", "dst").alias("edge"))
    steps = steps.distinct()
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array().cast("array<string>").alias("path"))
    found = None
    for d in range(1, depth + 1):
        front = front.join(steps, front["at"] == steps["node"]).where(~F.array_contains("path", F.col("edge")))
        front = front.select("start", F.col("other").alias("at"), F.array_append("path", F.col("edge")).alias("path"))
        if d >= min_depth:
            level = front.select("start", F.col("at").alias("node"), F.lit(d).alias("depth"), "path")
            found = level if found is None else found.unionByName(level)
    return found


def scoped_delete(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """The nodes that stay when each start (id, scope) goes with all nodes of its scope within 1..hops edges either way, over nodes of any scope."""
    steps = undirected(edges).select("node", "other").distinct()
    front = gone = starts.select("id", "scope")
    for _ in range(hops):
        front = front.join(steps, F.col("id") == F.col("node")).select(F.col("other").alias("id"), "scope").distinct()
        gone = gone.unionByName(front)
    return nodes.join(starts.select("id"), "id", "left_anti").join(gone.distinct(), ["id", "scope"], "left_anti")


def descendants(edges: DataFrame, roots: DataFrame, every: int = 8) -> DataFrame:
    """(id, depth): roots at depth 0 and what they reach over edges (src, dst), at its least depth, however deep and with cycles.

    Semi-naive: each round the frontier alone meets the edges, and only nodes that were not visited go on.  Rounds are written;
    every few rounds the visited ones are written together, so no plan grows with the depth.
    """
    e = kept(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    front = kept(roots.where("id is not null").select("id").distinct().withColumn("depth", F.lit(0)))
    visited, depth = [front], 0
    while not front.isEmpty():
        depth += 1
        met = front.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        for v in visited:
            met = met.join(v.select("id"), "id", "left_anti")
        front = kept(met.withColumn("depth", F.lit(depth)))
        visited.append(front)
        if len(visited) > every:
            whole = visited[0]
            for v in visited[1:]:
                whole = whole.unionByName(v)
            visited = [kept(whole)]
    out = visited[0]
    for v in visited[1:]:
        out = out.unionByName(v)
    return out


def induced(nodes: DataFrame, edges: DataFrame, in_set: Column) -> DataFrame:
    """Edges among the nodes in a set and their neighbours."""
    core = nodes.where(in_set).select("id")
    near = undirected(edges).join(core.withColumnRenamed("id", "node"), "node").select(F.col("other").alias("id"))
    keep = core.union(near).distinct()
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "rel", "dst")


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends known and no loops, each once."""
    ids = nodes.select("id").distinct()
    known = edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return known.select("src", "rel", "dst").distinct()


def remapped(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after merging nodes by mapping (old, new); loops that this makes go, the rest each once."""
    m = lambda end: mapping.select(F.col("old").alias(end), F.col("new").alias(f"{end}_new"))
    out = edges.join(m("src"), "src", "left").join(m("dst"), "dst", "left")
    return out.select(F.coalesce("src_new", "src").alias("src"), "rel", F.coalesce("dst_new", "dst").alias("dst")).where("src <> dst").distinct()


def risk(n: Column) -> Column:
    return F.when(n > 10, "high").when(n > 3, "medium").otherwise("low")
