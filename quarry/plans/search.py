"""Composite searches over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search, vectors
from .base import COSINE_SQL, op

_V = f"v AS (SELECT vec_id AS id, label, {COSINE_SQL} AS score FROM embeddings)"


def _hits(t, labels: list[int], k: int):
    e = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")
    return vectors.top_k(e, vectors.vector(t.query_vector()), k, where=F.col("label").isin(*labels)).select("id", F.col("score").alias("value"))


def _domains(t):
    return t.documents.groupBy(F.coalesce("lang", F.lit("none")).alias("id")).agg(F.count("*").alias("value"))


def _code(t):
    return lambda top: t.documents.join(F.broadcast(top.select(F.col("id").alias("doc_id"))), "doc_id").select(F.col("doc_id").alias("id"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("value"))


def _top(where: str, k: int) -> str:
    return f"(SELECT CAST(id AS VARCHAR) AS id, score AS value FROM v WHERE {where} ORDER BY score DESC, v.id LIMIT {k})"


@op("FUS6_full_search", f"""
WITH {_V}, e AS {_top('label = 3', 10)}
SELECT 'domains' AS level, coalesce(lang, 'none') AS id, CAST(count(*) AS DOUBLE) AS value FROM documents GROUP BY 2
UNION ALL SELECT 'entities', id, value FROM e
UNION ALL SELECT 'summaries', id, value FROM {_top('label IN (1, 2)', 10)}
UNION ALL SELECT 'code', CAST(doc_id AS VARCHAR), CAST(len(string_split(coalesce(text, ''), chr(10))) AS DOUBLE) FROM documents WHERE CAST(doc_id AS VARCHAR) = (SELECT id FROM e ORDER BY value DESC, CAST(id AS BIGINT) LIMIT 1)""")
def _(t):
    return search.levels(search.full_search(3, lambda: _domains(t), lambda: _hits(t, [3], 10), lambda: _hits(t, [1, 2], 10), _code(t)))


@op("FUS7_document_sweep", f"""
WITH {_V}
SELECT 'collections' AS level, coalesce(source, 'none') AS id, CAST(count(*) AS DOUBLE) AS value FROM documents GROUP BY 2
UNION ALL SELECT 'chunks', id, value FROM {_top('label = 0', 10)}
UNION ALL SELECT 'summaries', id, value FROM {_top('label IN (1, 2)', 10)}
UNION ALL SELECT 'entities', id, value FROM {_top('label = 3', 10)}""")
def _(t):
    found = {"collections": t.documents.groupBy(F.coalesce("source", F.lit("none")).alias("id")).agg(F.count("*").alias("value")), "chunks": _hits(t, [0], 10), "summaries": _hits(t, [1, 2], 10), "entities": _hits(t, [3], 10)}
    return search.levels(found)


_LEX = r"list_distinct([w FOR w IN regexp_split_to_array(lower(text), '\s+') IF w <> ''])"


def _lexical(t, k: int):
    q = F.lit(t.benchmark.where("item_id = 0").select("text").first()[0])
    return t.documents.select(F.col("doc_id").alias("id"), F.round(tx.lexical_score(F.coalesce("text", F.lit("")), q), 6).alias("value")).orderBy(F.desc("value"), "id").limit(k)


def _triplets(t, k: int):
    hits = {str(label): _hits(t, [label], 100).select("id", (1 - F.col("value")).alias("distance")) for label in range(5)}
    e = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("rel"), F.col("l_partkey").alias("dst"))
    return search.scoped_triplets(hits, e, k, F.col("dst") % 2 == 0)


_HITS_SQL = ", ".join(f"h{label} AS (SELECT id, 1 - score AS distance FROM v WHERE label = {label} ORDER BY score DESC, id LIMIT 100)" for label in range(5))
_TRIPLETS_SQL = f"""{_HITS_SQL}, near AS ({' UNION ALL '.join(f'SELECT * FROM h{label}' for label in range(5))}),
e AS (SELECT DISTINCT l_suppkey AS src, l_linenumber AS rel, l_partkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT id FROM near) AND l_partkey IN (SELECT id FROM near)),
tri AS (SELECT src, rel, dst, round((coalesce(a.distance, 3.5) + coalesce(r.distance, 3.5) + coalesce(b.distance, 3.5)) * CASE WHEN dst % 2 = 0 THEN 0.7 ELSE 1.0 END, 5) AS importance
  FROM e LEFT JOIN near a ON a.id = src LEFT JOIN near r ON r.id = rel LEFT JOIN near b ON b.id = dst ORDER BY importance, src, rel, dst LIMIT 25)"""


@op("TOP8_scoped_triplets", f"WITH {_V}, {_TRIPLETS_SQL} SELECT src, rel, dst, importance FROM tri")
def _(t):
    return _triplets(t, 25)


@op("FUS10_search_modes", f"""
WITH {_V}, {_TRIPLETS_SQL}, q AS (SELECT {_LEX} AS q FROM benchmark WHERE item_id = 0),
w AS (SELECT doc_id, {_LEX} AS w FROM documents),
x AS (SELECT CAST(doc_id AS VARCHAR) AS id, round(coalesce(CAST(len(list_intersect(w, (SELECT q FROM q))) AS DOUBLE) / len(list_distinct(list_concat(w, (SELECT q FROM q)))), 0.0), 6) AS value FROM w ORDER BY value DESC, doc_id LIMIT 10),
found AS (
  SELECT 'graph' AS form, id, value FROM {_top('label = 3', 10)} UNION ALL SELECT 'chunks', id, value FROM {_top('label = 0', 10)} UNION ALL SELECT 'summaries', id, value FROM {_top('label IN (1, 2)', 10)}
  UNION ALL SELECT 'rules', id, value FROM {_top('label = 4', 10)} UNION ALL SELECT 'lexical', id, value FROM x
  UNION ALL SELECT 'triplets', src || '>' || rel || '>' || dst, importance FROM tri
  UNION ALL SELECT 'time', id, value FROM (SELECT CAST(event_id AS VARCHAR) AS id, value FROM events ORDER BY ts DESC, event_id LIMIT 10)),
m(level, form) AS (VALUES ('GRAPH_COMPLETION', 'graph'), ('GRAPH_COMPLETION_COT', 'graph'), ('GRAPH_COMPLETION_CONTEXT_EXTENSION', 'graph'), ('FEELING_LUCKY', 'graph'), ('NO_SUCH_MODE', 'graph'), ('TRIPLET_COMPLETION', 'triplets'),
  ('CHUNKS', 'chunks'), ('RAG_COMPLETION', 'chunks'), ('SUMMARIES', 'summaries'), ('GRAPH_SUMMARY_COMPLETION', 'summaries'), ('TEMPORAL', 'time'), ('CODING_RULES', 'rules'), ('CHUNKS_LEXICAL', 'lexical'))
SELECT level, id, CAST(value AS DOUBLE) AS value FROM m JOIN found USING (form)""")
def _(t):
    graph_form, chunks, summaries = (lambda: _hits(t, [3], 10)), (lambda: _hits(t, [0], 10)), (lambda: _hits(t, [1, 2], 10))
    triplets = lambda: _triplets(t, 25).select(F.concat_ws(">", "src", "rel", "dst").alias("id"), F.col("importance").alias("value"))
    time = lambda: t.events.orderBy(F.desc("ts"), "event_id").limit(10).select(F.col("event_id").alias("id"), "value")
    searches = {"GRAPH_COMPLETION": graph_form, "GRAPH_COMPLETION_COT": graph_form, "GRAPH_COMPLETION_CONTEXT_EXTENSION": graph_form, "FEELING_LUCKY": graph_form, "TRIPLET_COMPLETION": triplets, "CHUNKS": chunks, "RAG_COMPLETION": chunks, "SUMMARIES": summaries, "GRAPH_SUMMARY_COMPLETION": summaries, "TEMPORAL": time, "CODING_RULES": lambda: _hits(t, [4], 10), "CHUNKS_LEXICAL": lambda: _lexical(t, 10)}
    return search.levels({m: search.search_in_mode(m, searches) for m in (*searches, "NO_SUCH_MODE")})


@op("FLT23_existing_collections", "WITH want(name) AS (SELECT DISTINCT source FROM documents UNION SELECT 'src-none'), have AS (SELECT DISTINCT source AS name FROM documents JOIN embeddings ON vec_id = doc_id) SELECT name FROM want WHERE name IN (SELECT name FROM have)")
def _(t):
    d = t.documents
    want = d.select(F.col("source").alias("name")).unionByName(t.spark.createDataFrame([("src-none",)], "name string")).distinct()
    have = d.join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("source").alias("name"))
    return want.join(have, "name", "left_semi")


@op("FLT24_depth_presets", """
WITH p AS (SELECT p_partkey, list_extract(['concise', ' Standard', 'thorough', 'deep', NULL], CAST(p_size % 5 AS INT) + 1) AS depth, CASE WHEN p_size % 7 = 0 THEN p_size % 3 * 25 END AS own FROM part),
n AS (SELECT *, CASE WHEN lower(trim(depth)) IN ('concise', 'standard') THEN lower(trim(depth)) ELSE 'thorough' END AS name FROM p)
SELECT p_partkey, CAST(coalesce(nullif(own, 0), CASE name WHEN 'concise' THEN 10 WHEN 'standard' THEN 20 ELSE 30 END) AS INT) AS top_k, CAST(CASE name WHEN 'concise' THEN 100 WHEN 'standard' THEN 200 ELSE 300 END AS INT) AS wide_top_k FROM n""")
def _(t):
    depth = F.get(F.array(*[F.lit(x) for x in ("concise", " Standard", "thorough", "deep", None)]), (F.col("p_size") % 5).cast("int"))
    own = F.when(F.col("p_size") % 7 == 0, F.col("p_size") % 3 * 25)
    return t.part.select("p_partkey", search.depth_preset(depth, own, F.lit(None)).alias("d")).select("p_partkey", "d.top_k", "d.wide_top_k")


@op("SET5_ordered_distinct", r"""
WITH w AS (SELECT item_id, [trim(x) FOR x IN string_split(text, ' ') IF trim(x) <> ''] AS w FROM benchmark)
SELECT item_id, array_to_string(([x FOR x, i IN w IF list_position(w, x) = i])[1:5], '|') AS variants FROM w""")
def _(t):
    return t.benchmark.select("item_id", F.array_join(search.ordered_distinct(F.split("text", " "), 5), "|").alias("variants"))
