"""Property-graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import graph
from .base import GRAPH_SQL, op


def _starts(t, where: str):
    return t.nodes().where(where).select("id")


_NEAR = "r AS (SELECT node, rel, other, outgoing, row_number() OVER (PARTITION BY node ORDER BY rel, other, outgoing) AS nr FROM (SELECT DISTINCT b.* FROM both_ways b JOIN nodes ON id = node WHERE {0}))"


@op("JN3_neighbours", f"WITH {GRAPH_SQL}, {_NEAR.format(chr(39) + 'supplier' + chr(39) + ' = label')} SELECT node, rel, other, outgoing FROM r WHERE nr <= 10")
def _(t):
    return graph.neighbours(t.edges(), _starts(t, "label = 'supplier'"), 10).drop("nr")


@op("JN4_traverse", f"WITH {GRAPH_SQL}, {_NEAR.format('id = ' + chr(39) + 's7' + chr(39))} SELECT node, rel, other, outgoing FROM r WHERE nr <= 50")
def _(t):
    return graph.neighbours(t.edges(), _starts(t, "id = 's7'"), 50).drop("nr")


@op("JN5_traverse_scoped", f"WITH {GRAPH_SQL}, {_NEAR.format('scope = ' + chr(39) + 'n3' + chr(39))} SELECT node, rel, other, outgoing FROM r WHERE nr <= 50")
def _(t):
    return graph.neighbours(t.edges(), _starts(t, "scope = 'n3'"), 50).drop("nr")


_HOPS = """
p AS (SELECT 'p1' AS start, other AS node, 1 AS depth, [edge] AS path FROM steps WHERE node = 'p1'
      UNION ALL SELECT start, other, depth + 1, list_append(path, edge) FROM p JOIN steps s ON s.node = p.node WHERE depth < {0} AND NOT list_contains(path, edge))"""
_OUT = "steps AS (SELECT DISTINCT src AS node, dst AS other, src || '|' || rel || '|' || dst AS edge FROM edges)"
_IN = "steps AS (SELECT DISTINCT dst AS node, src AS other, src || '|' || rel || '|' || dst AS edge FROM edges)"
_BOTH = "steps AS (SELECT DISTINCT node, other, CASE WHEN outgoing THEN node || '|' || rel || '|' || other ELSE other || '|' || rel || '|' || node END AS edge FROM both_ways)"


@op("JN6_subgraph", f"WITH RECURSIVE {GRAPH_SQL}, {_BOTH}, {_HOPS.format(2)}, e AS (SELECT DISTINCT unnest(path) AS edge FROM p) SELECT edge FROM e ORDER BY edge LIMIT 100")
def _(t):
    p = graph.paths(t.edges(), _starts(t, "id = 'p1'"), 2, "both")
    return p.select(F.explode("path").alias("edge")).distinct().orderBy("edge").limit(100)


@op("JN7_upstream", f"WITH RECURSIVE {GRAPH_SQL}, {_IN}, {_HOPS.format(3).replace(chr(39) + 'p1' + chr(39), chr(39) + 'r0' + chr(39)).replace('{0}', '2')} SELECT node, depth, array_to_string(path, ' ') AS path FROM p ORDER BY depth, node, path LIMIT 50")
def _(t):
    p = graph.paths(t.edges(), _starts(t, "id = 'r0'"), 3, "in")
    return p.select("node", "depth", F.array_join("path", " ").alias("path")).orderBy("depth", "node", "path").limit(50)


@op("JN8_downstream", f"WITH RECURSIVE {GRAPH_SQL}, {_OUT}, {_HOPS.format(3)}, n AS (SELECT count(DISTINCT node) AS reached FROM p) SELECT reached, CASE WHEN reached > 10 THEN 'high' WHEN reached > 3 THEN 'medium' ELSE 'low' END AS risk FROM n")
def _(t):
    n = graph.paths(t.edges(), _starts(t, "id = 'p1'"), 3, "out").agg(F.countDistinct("node").alias("reached"))
    return n.select("reached", graph.risk(F.col("reached")).alias("risk"))


@op("JN9_flow", f"WITH RECURSIVE {GRAPH_SQL}, {_OUT}, {_HOPS.format(5)} SELECT node, depth, array_to_string(path, ' ') AS path FROM p ORDER BY depth DESC, path LIMIT 10")
def _(t):
    return graph.paths(t.edges(), _starts(t, "id = 'p1'"), 5, "out").select("node", "depth", F.array_join("path", " ").alias("path")).orderBy(F.desc("depth"), "path").limit(10)


@op("JN10_related_by_depth", f"WITH RECURSIVE {GRAPH_SQL}, {_BOTH}, {_HOPS.format(2)} SELECT DISTINCT node, depth FROM p ORDER BY depth, node LIMIT 200")
def _(t):
    return graph.paths(t.edges(), _starts(t, "id = 'p1'"), 2, "both").select("node", "depth").distinct().orderBy("depth", "node").limit(200)


@op("JN11_descendants", f"WITH RECURSIVE {GRAPH_SQL}, t AS (SELECT id, 0 AS depth FROM nodes WHERE id = 'r1' UNION ALL SELECT src, depth + 1 FROM t JOIN edges ON dst = id WHERE rel <> 'supplied_by') SELECT id, min(depth) AS depth FROM t GROUP BY 1")
def _(t):
    return graph.descendants(t.edges().where("rel <> 'supplied_by'").select(F.col("dst").alias("src"), F.col("src").alias("dst")), _starts(t, "id = 'r1'"))


@op("JN13_code_with_fallback", "WITH a AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1), b AS (SELECT p_partkey AS l_partkey, CAST(0 AS BIGINT) AS l_suppkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM a)) SELECT * FROM a UNION ALL SELECT * FROM b")
def _(t):
    a = t.lineitem.where("l_returnflag = 'R' and l_linenumber = 1").select("l_partkey", "l_suppkey")
    b = t.part.select(F.col("p_partkey").alias("l_partkey")).join(a.select("l_partkey").distinct(), "l_partkey", "left_anti").withColumn("l_suppkey", F.lit(0).cast("long"))
    return a.unionByName(b)


@op("JN21_valid_edges", f"WITH {GRAPH_SQL}, n AS (SELECT id FROM nodes WHERE id NOT IN ('s1', 'n2')) SELECT DISTINCT src, rel, dst FROM edges WHERE src <> dst AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def _(t):
    return graph.valid_edges(t.nodes().where("id not in ('s1', 'n2')"), t.edges())


@op("JN22_replace_endpoints", f"WITH {GRAPH_SQL} SELECT DISTINCT src, rel, CASE WHEN dst = 's2' THEN 's1' ELSE dst END AS dst FROM edges WHERE rel = 'supplied_by'")
def _(t):
    m = t.spark.range(1).select(F.lit("s2").alias("old"), F.lit("s1").alias("new"))
    return graph.remapped(t.edges().where("rel = 'supplied_by'"), m)


@op("JN23_reject_propagation", f"WITH {GRAPH_SQL}, x AS (SELECT id FROM nodes WHERE scope = 'n5') SELECT src, rel, dst FROM edges WHERE src NOT IN (SELECT id FROM x) AND dst NOT IN (SELECT id FROM x)")
def _(t):
    x = _starts(t, "scope = 'n5'")
    return t.edges().join(x.withColumnRenamed("id", "src"), "src", "left_anti").join(x.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "rel", "dst")


@op("JN24_id_remap", f"WITH {GRAPH_SQL}, m AS (SELECT id AS old, 's' || (CAST(substr(id, 2) AS BIGINT) // 2) AS new FROM nodes WHERE label = 'supplier') SELECT DISTINCT coalesce(a.new, src) AS src, rel, coalesce(b.new, dst) AS dst FROM edges LEFT JOIN m a ON a.old = src LEFT JOIN m b ON b.old = dst WHERE coalesce(a.new, src) <> coalesce(b.new, dst)")
def _(t):
    m = t.nodes().where("label = 'supplier'").select(F.col("id").alias("old"), F.concat(F.lit("s"), F.expr("cast(substring(id, 2) as bigint) div 2").cast("string")).alias("new"))
    return graph.remapped(t.edges(), m)


@op("JN26_induced_subgraph", f"WITH {GRAPH_SQL}, e AS MATERIALIZED (SELECT * FROM edges), c AS MATERIALIZED (SELECT DISTINCT id FROM nodes WHERE scope = 'n4'), k AS MATERIALIZED (SELECT id FROM c UNION SELECT dst FROM e JOIN c ON src = id UNION SELECT src FROM e JOIN c ON dst = id) SELECT e.src, e.rel, e.dst FROM e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst")
def _(t):
    return graph.induced(t.nodes(), t.edges(), F.col("scope") == "n4")


@op("JN26_induced_edges", f"WITH {GRAPH_SQL}, e AS MATERIALIZED (SELECT * FROM edges), c AS MATERIALIZED (SELECT DISTINCT id FROM nodes WHERE scope = 'n4'), k AS MATERIALIZED (SELECT id FROM c UNION SELECT dst FROM e JOIN c ON src = id UNION SELECT src FROM e JOIN c ON dst = id) SELECT e.src, e.rel, e.dst FROM e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst")
def _(t):
    return graph.induced(t.nodes(), t.edges(), F.col("scope") == "n4")


@op("JN11_descendants_cyclic", "WITH RECURSIVE g AS (SELECT o_orderkey AS src, (o_orderkey * 7 + o_custkey) % 1500 AS dst FROM orders), r AS (SELECT CAST(1 AS BIGINT) AS id UNION SELECT CAST(dst AS BIGINT) FROM r JOIN g ON src = id) SELECT id FROM r")
def _(t):
    g = t.orders.select(F.col("o_orderkey").alias("src"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 1500).alias("dst"))
    return graph.descendants(g, t.spark.range(1, 2).select("id")).select("id")


@op("JN27_bounded_projection", f"WITH {GRAPH_SQL}, h AS (SELECT 's' || vec_id AS id FROM embeddings WHERE label = 1 UNION ALL SELECT 'p' || vec_id FROM embeddings WHERE label = 1) SELECT src, rel, dst FROM edges WHERE src IN (SELECT id FROM h) AND dst IN (SELECT id FROM h)")
def _(t):
    e = t.embeddings.where("label = 1")
    h = e.select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("id")).union(e.select(F.concat(F.lit("p"), F.col("vec_id").cast("string"))))
    return t.edges().join(h.withColumnRenamed("id", "src"), "src", "left_semi").join(h.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "rel", "dst")


@op("JN29_domain_edges", f"WITH {GRAPH_SQL} SELECT id AS src, 'belongs_to_domain' AS rel, lower(scope) AS dst FROM nodes WHERE label = 'part' AND scope <> '' AND EXISTS (SELECT 1 FROM edges WHERE edges.src = nodes.id)")
def _(t):
    n = t.nodes().where("label = 'part' and scope <> ''").join(t.edges().select(F.col("src").alias("id")), "id", "left_semi")
    return n.select(F.col("id").alias("src"), F.lit("belongs_to_domain").alias("rel"), F.lower("scope").alias("dst"))


@op("JN30_summary_edges", f"WITH {GRAPH_SQL} SELECT n.id AS src, 'has_summary' AS rel, m.id AS dst FROM nodes n JOIN nodes m ON m.id = n.scope WHERE n.label = 'supplier'")
def _(t):
    n = t.nodes()
    return n.where("label = 'supplier'").select(F.col("id").alias("src"), F.lit("has_summary").alias("rel"), F.col("scope").alias("dst")).join(n.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "rel", "dst")


@op("GRB3_document_nodes", "WITH r AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nr FROM conversations) SELECT conv_id, role AS first_role FROM r WHERE nr = 1")
def _(t):
    return t.conversations.withColumn("nr", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("nr = 1").select("conv_id", F.col("role").alias("first_role"))


@op("GRB3c_node_sets", "SELECT DISTINCT source || '_knowledge' AS name FROM documents")
def _(t):
    return t.documents.select(F.concat("source", F.lit("_knowledge")).alias("name")).distinct()


@op("GRB3d_hierarchy", "SELECT r_name AS company, n_name AS project, count(c_custkey) AS branches FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(t):
    return t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("r_name").alias("company"), F.col("n_name").alias("project")).agg(F.count("c_custkey").alias("branches"))


@op("GRB4_cross_file", "SELECT l_partkey AS entity, l_orderkey AS doc, CASE WHEN bool_or(l_returnflag = 'A') THEN 'defined_in' ELSE 'imported_by' END AS rel FROM lineitem GROUP BY 1, 2")
def _(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("doc")).agg(F.when(F.bool_or(F.col("l_returnflag") == "A"), "defined_in").otherwise("imported_by").alias("rel"))


@op("GRB9_delete_cascade", "SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey % 7 = 0) AS chunks, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING bool_and(l_orderkey % 7 = 0))) AS entities")
def _(t):
    gone = F.col("l_orderkey") % 7 == 0
    a = t.lineitem.agg(F.count_if(gone).alias("chunks")).withColumn("k", F.lit(1))
    b = t.lineitem.groupBy("l_partkey").agg(F.bool_and(gone).alias("g")).agg(F.count_if("g").alias("entities")).withColumn("k", F.lit(1))
    return a.join(b, "k").drop("k")


@op("REL10_scoped_delete", f"WITH RECURSIVE {GRAPH_SQL}, {_BOTH}, {_HOPS.format(2)}, g AS (SELECT 'p1' AS id UNION SELECT node FROM p) SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM g)")
def _(t):
    reached = graph.paths(t.edges(), _starts(t, "id = 'p1'"), 2, "both").select(F.col("node").alias("id"))
    gone = reached.union(_starts(t, "id = 'p1'")).distinct()
    return t.nodes().select("id").join(gone, "id", "left_anti")


@op("REL10_scoped_delete_all", f"""WITH RECURSIVE {GRAPH_SQL}, steps AS (SELECT DISTINCT node, other FROM both_ways),
p AS (SELECT id AS node, 0 AS depth, scope FROM nodes WHERE id = 'p1' UNION SELECT other, depth + 1, scope FROM p JOIN steps s ON s.node = p.node WHERE depth < 3)
SELECT id FROM nodes n WHERE id <> 'p1' AND NOT EXISTS (SELECT 1 FROM p WHERE p.node = n.id AND p.scope = n.scope)""")
def _(t):
    return graph.scoped_delete(t.nodes(), t.edges(), t.nodes().where("id = 'p1'")).select("id")




@op("SCL1_graph_ids")
def _(t):
    return t.nodes().select("id", ids.graph_id(F.col("name")).alias("uuid"), ids.entity_id(F.col("name"), F.col("scope")).alias("entity"))


@op("SCL2_hash_ids", "SELECT doc_id, substr(sha256(source || ':' || lang || ':' || doc_id), 1, 32) AS hash32, substr(sha256(source || '::' || doc_id), 1, 16) AS chunk_id, substr(md5(text), 1, 8) AS fusion_id FROM documents")
def _(t):
    return t.documents.select("doc_id", ids.hash32(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("hash32"), ids.chunk_id(F.col("source"), F.col("doc_id")).alias("chunk_id"), ids.fusion_id(F.col("text")).alias("fusion_id"))
