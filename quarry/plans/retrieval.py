"""Vector, lexical and hybrid retrieval, and payload filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fusion, vectors
from .base import COSINE_SQL, op


def _vec(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


def _scored(t):
    return _vec(t).withColumn("score", F.round(vectors.cosine(F.col("embedding"), vectors.vector(t.query_vector())), 6))


_V = f"v AS (SELECT vec_id AS id, label, {COSINE_SQL} AS score FROM embeddings)"


@op("TOP1_entity_search", f"WITH {_V} SELECT id, label, score FROM v WHERE label = 3 ORDER BY score DESC, id LIMIT 10")
def _(t):
    return vectors.top_k(_vec(t), vectors.vector(t.query_vector()), 10, where=vectors.matching(must={"label": 3})).select("id", "label", "score")


@op("TOP2_summary_search", f"WITH {_V}, k AS (SELECT * FROM v WHERE label IN (1, 2) ORDER BY score DESC, id LIMIT 10) SELECT id, label, score FROM k WHERE score >= 0.1")
def _(t):
    return vectors.top_k(_vec(t), vectors.vector(t.query_vector()), 10, where=vectors.matching(any_of={"label": [1, 2]}), floor=0.1).select("id", "label", "score")


@op("TOP3_document_search", f"WITH {_V} SELECT id, score FROM v ORDER BY score DESC, id LIMIT 20")
def _(t):
    return vectors.top_k(_vec(t), vectors.vector(t.query_vector()), 20).select("id", "score")


@op("TOP4_tenant_code_search", f"WITH {_V} SELECT id, label, score FROM v WHERE label NOT IN (0) ORDER BY score DESC, id LIMIT 10")
def _(t):
    return vectors.top_k(_vec(t), vectors.vector(t.query_vector()), 10, where=vectors.matching(must_not={"label": [0]})).select("id", "label", "score")


@op("TOP5_memory_search", f"WITH {_V} SELECT id, label, score FROM v WHERE label >= 5 ORDER BY score DESC, id LIMIT 10")
def _(t):
    return vectors.top_k(_vec(t), vectors.vector(t.query_vector()), 10, where=vectors.matching(at_least={"label": 5})).select("id", "label", "score")


@op("TOP6_agent_search", f"WITH {_V}, k AS (SELECT * FROM v ORDER BY score DESC, id LIMIT 20), f AS (SELECT * FROM k WHERE score >= 0.05 AND label <> 4) SELECT f.id, score, d.lang FROM f JOIN documents d ON d.doc_id = f.id ORDER BY score DESC, f.id LIMIT 10")
def _(t):
    hits = vectors.top_k(_vec(t), vectors.vector(t.query_vector()), 20, floor=0.05).where("label <> 4")
    return hits.join(t.documents.select(F.col("doc_id").alias("id"), "lang"), "id").orderBy(F.desc("score"), "id").limit(10).select("id", "score", "lang")


@op("TOP7_triplet_importance", """
WITH d AS (SELECT vec_id AS id, 1 - round(list_cosine_similarity([CAST(x AS DOUBLE) FOR x IN embedding], [CAST(x AS DOUBLE) FOR x IN (SELECT embedding FROM embeddings WHERE vec_id = 0)]), 6) AS distance FROM embeddings WHERE vec_id < 300),
e AS (SELECT DISTINCT l_suppkey AS src, l_linenumber AS rel, l_partkey % 400 AS dst FROM lineitem)
SELECT src, rel, dst, round((coalesce(a.distance, 3.5) + coalesce(r.distance, 3.5) + coalesce(b.distance, 3.5)) * CASE WHEN dst % 2 = 0 THEN 0.7 ELSE 1.0 END, 5) AS importance
FROM e LEFT JOIN d a ON a.id = src LEFT JOIN d r ON r.id = rel LEFT JOIN d b ON b.id = dst ORDER BY importance, src, rel, dst LIMIT 25""")
def _(t):
    d = _scored(t).where("id < 300").select("id", (1 - F.col("score")).alias("distance"))
    e = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("rel"), (F.col("l_partkey") % 400).alias("dst")).distinct()
    return vectors.triplet_importance(e, d, 25, F.col("dst") % 2 == 0)


@op("TOP7_triplet_importance_all", f"""
WITH d AS (SELECT vec_id AS id, 1 - {COSINE_SQL} AS distance FROM embeddings),
e AS (SELECT DISTINCT l_suppkey AS src, l_linenumber AS rel, l_partkey AS dst FROM lineitem)
SELECT src, rel, dst, round((coalesce(a.distance, 3.5) + coalesce(r.distance, 3.5) + coalesce(b.distance, 3.5)) * CASE WHEN dst % 2 = 0 THEN 0.7 ELSE 1.0 END, 5) AS importance
FROM e LEFT JOIN d a ON a.id = src LEFT JOIN d r ON r.id = rel LEFT JOIN d b ON b.id = dst ORDER BY importance, src, rel, dst LIMIT 25""")
def _(t):
    d = _scored(t).select("id", (1 - F.col("score")).alias("distance"))
    e = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("rel"), F.col("l_partkey").alias("dst")).distinct()
    return vectors.triplet_importance(e, d, 25, F.col("dst") % 2 == 0)


@op("TOP9_batch_search", """
WITH q AS (SELECT vec_id AS query_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS q FROM embeddings WHERE vec_id < 5),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity([CAST(x AS DOUBLE) FOR x IN embedding], q), 6) AS score FROM embeddings, q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s)
SELECT query_id, id, score, rank FROM r WHERE rank <= 100""")
def _(t):
    return vectors.top_k_each(_vec(t), t.embeddings.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 100).select("query_id", "id", "score", "rank")


_LEX = r"list_distinct([w FOR w IN regexp_split_to_array(lower(text), '\s+') IF w <> ''])"


@op("TOP10_lexical_chunks", rf"""
WITH q AS (SELECT {_LEX} AS q FROM benchmark WHERE item_id = 0), d AS (SELECT doc_id, {_LEX} AS w FROM documents WHERE lang = 'en'),
s AS (SELECT doc_id, round(CAST(len(list_intersect(w, (SELECT q FROM q))) AS DOUBLE) / len(list_distinct(list_concat(w, (SELECT q FROM q)))), 6) AS score FROM d)
SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20""")
def _(t):
    q = F.lit(t.benchmark.where("item_id = 0").select("text").first()[0])
    return t.documents.where("lang = 'en'").select("doc_id", F.round(tx.lexical_score(F.col("text"), q), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@op("TOP11_name_relevance", "SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'green' THEN CAST(1.0 AS DOUBLE) WHEN contains(lower(p_name), 'green') THEN 0.8 ELSE 0.5 END AS score FROM part ORDER BY score DESC, p_partkey LIMIT 50")
def _(t):
    n = F.lower("p_name")
    return t.part.select("p_partkey", "p_name", F.when(n == "green", 1.0).when(n.contains("green"), 0.8).otherwise(0.5).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(50)


@op("TOP12_importance_then_time", "SELECT event_id, value, ts FROM events WHERE event_type = 'click' ORDER BY value DESC, ts DESC, event_id LIMIT 50")
def _(t):
    return t.events.where("event_type = 'click'").select("event_id", "value", "ts").orderBy(F.desc("value"), F.desc("ts"), "event_id").limit(50)


@op("TOP13_nulls_last", "SELECT doc_id, nullif(lang, 'de') AS lang FROM documents ORDER BY nullif(lang, 'de') DESC NULLS LAST, doc_id LIMIT 900")
def _(t):
    return nulls_last(t.documents).limit(900)


def nulls_last(documents):
    """All documents by language from the last one, those without (German here) at the end."""
    return documents.select("doc_id", F.nullif("lang", F.lit("de")).alias("lang")).orderBy(F.desc_nulls_last("lang"), "doc_id")


@op("TOP13_nulls_last_all", "SELECT doc_id, nullif(lang, 'de') AS lang FROM documents ORDER BY nullif(lang, 'de') DESC NULLS LAST, doc_id")
def _(t):
    return nulls_last(t.documents)


@op("TOP14_page", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 25 OFFSET 50")
def _(t):
    return t.documents.select("doc_id", "source").orderBy("source", "doc_id").offset(50).limit(25)


@op("TOP15_best_per_key", "WITH g AS (SELECT event_id % 500 AS id, value AS score, event_id AS first_order FROM events) SELECT id, max(score) AS score, min(first_order) AS first_order FROM g GROUP BY id ORDER BY score DESC, first_order, id LIMIT 20")
def _(t):
    return vectors.best_per_key(t.events.select((F.col("event_id") % 500).alias("id"), F.col("value").alias("score"), F.col("event_id").alias("first_order")), 20)


@op("TOP16_temporal_search", f"WITH {_V}, e AS (SELECT DISTINCT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01 00:30:00' AND ts <= TIMESTAMP '2024-01-01 08:00:00') SELECT id, score FROM v JOIN e ON event_id = id ORDER BY score DESC, id LIMIT 10")
def _(t):
    e = t.events.where("ts >= timestamp'2024-01-01 00:30:00' and ts <= timestamp'2024-01-01 08:00:00'").select(F.col("event_id").alias("id")).distinct()
    return vectors.top_k(_vec(t).join(e, "id", "left_semi"), vectors.vector(t.query_vector()), 10).select("id", "score")


@op("FLT1_equality", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src1'")
def _(t):
    return t.documents.where(vectors.matching(must={"lang": "en", "source": "src1"})).select("doc_id", "lang", "source")


@op("FLT2_any_of", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def _(t):
    return t.documents.where(vectors.matching(any_of={"lang": ["de", "fr"]})).select("doc_id", "lang")


@op("FLT3_exclusion", "SELECT doc_id, nullif(lang, 'es') AS lang FROM documents WHERE coalesce(nullif(lang, 'es') NOT IN ('de'), true)")
def _(t):
    return t.documents.select("doc_id", F.nullif("lang", F.lit("es")).alias("lang")).where(vectors.matching(must_not={"lang": ["de"]}))


@op("FLT4_range", "SELECT event_id, value FROM events WHERE value >= 50")
def _(t):
    return t.events.where(vectors.matching(at_least={"value": 50})).select("event_id", "value")


@op("FLT5_tag_search", "SELECT doc_id, lang, source, CAST(1.0 AS DOUBLE) AS score FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') ORDER BY doc_id LIMIT 100")
def _(t):
    return t.documents.where(vectors.matching(must={"lang": "en"}, any_of={"source": ["src1", "src2"]})).select("doc_id", "lang", "source", F.lit(1.0).alias("score")).orderBy("doc_id").limit(100)


@op("FLT6_condition_dsl", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 2, 3) AND vec_id <> 7")
def _(t):
    return t.embeddings.where(vectors.compile_filter({"must": [{"key": "label", "match": {"any": [1, 2, 3]}}], "must_not": [{"key": "vec_id", "match": {"value": 7}}]})).select("vec_id", "label")


@op("FLT7_contains_any_column", "SELECT p_partkey FROM part WHERE contains(lower(coalesce(p_name, '')), 'red') OR contains(lower(coalesce(p_brand, '')), 'red') OR contains(lower(coalesce(p_type, '')), 'red')")
def _(t):
    has = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains("red")
    return t.part.where(has("p_name") | has("p_brand") | has("p_type")).select("p_partkey")


@op("FLT8_prefix_suffix", "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://') AND suffix(url, '.html')")
def _(t):
    return t.pages.where(F.col("url").startswith("https://") & F.col("url").endswith(".html")).select("page_id", "url")


@op("FLT9_path_exclusion", "SELECT page_id FROM pages WHERE NOT (contains(url, '/de/') OR contains(url, 'blog.'))")
def _(t):
    return t.pages.where(~(F.col("url").contains("/de/") | F.col("url").contains("blog."))).select("page_id")


@op("FLT13_min_size", "SELECT doc_id, length(trim(text)) AS n FROM documents WHERE length(trim(text)) >= 50")
def _(t):
    return t.documents.select("doc_id", F.length(F.trim("text")).cast("long").alias("n")).where("n >= 50")


@op("FLT14_score_floor", f"WITH {_V}, k AS (SELECT * FROM v ORDER BY score DESC, id LIMIT 10) SELECT count(*) AS n_raw, count(*) FILTER (WHERE score >= 0.78) AS n_kept, CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE score >= 1.01) = 0 THEN 'low confidence' END AS reason FROM k")
def _(t):
    k = vectors.top_k(_vec(t), vectors.vector(t.query_vector()), 10)
    return k.agg(F.count("*").alias("n_raw"), F.count_if(F.col("score") >= vectors.ENTITY_FLOOR).alias("n_kept"), F.when((F.count("*") > 0) & (F.count_if(F.col("score") >= 1.01) == 0), "low confidence").alias("reason"))


@op("FLT15_projection_defaults", "SELECT doc_id, coalesce(nullif(source, ''), lang) AS origin, substr(text, 1, 500) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", F.coalesce(F.nullif("source", F.lit("")), "lang").alias("origin"), F.substring("text", 1, 500).alias("text"))


@op("FLT16_processable", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents WHERE strlen(text) BETWEEN 100 AND 20000 AND NOT contains(lower(substr(text, 1, 1000)), 'license') AND source <> 'src0'")
def _(t):
    from ..operators.chunking import estimated_tokens

    keep = F.octet_length("text").between(100, 20000) & ~F.lower(F.substring("text", 1, 1000)).contains("license") & (F.col("source") != "src0")
    return t.documents.where(keep).select("doc_id", estimated_tokens(F.col("text")).cast("long").alias("tokens"))


@op("FUS1_rrf", f"""
WITH {_V}, a AS (SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM v ORDER BY score DESC, id LIMIT 50),
b AS (SELECT vec_id AS id, CAST(row_number() OVER (ORDER BY label DESC, vec_id) AS INT) AS rank FROM embeddings ORDER BY label DESC, vec_id LIMIT 50),
u AS (SELECT id, 0 AS list_idx, 1.0 / (60 + rank) AS s FROM a UNION ALL SELECT id, 1, 0.8 / (60 + rank) FROM b),
f AS (SELECT id, round(sum(CAST(s AS DOUBLE)), 9) AS score FROM u GROUP BY id ORDER BY score DESC, id LIMIT 10)
SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS fusion_rank FROM f""")
def _(t):
    a = _scored(t).orderBy(F.desc("score"), "id").limit(50).withColumn("payload", F.lit("vector"))
    b = _vec(t).orderBy(F.desc("label"), "id").limit(50).withColumn("payload", F.lit("label"))
    lists = fusion.ranked(a, 0, 1.0, [F.desc("score"), F.col("id")]).unionByName(fusion.ranked(b, 1, 0.8, [F.desc("label"), F.col("id")]))
    return fusion.rrf(lists).select("id", "score", "fusion_rank")


_HYBRID = rf"""
WITH {_V}, a AS (SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM v ORDER BY score DESC, id LIMIT 20),
q AS (SELECT {_LEX} AS q FROM benchmark WHERE item_id = 0), d AS (SELECT doc_id, {_LEX} AS w FROM documents),
s AS (SELECT doc_id AS id, round(CAST(len(list_intersect(w, (SELECT q FROM q))) AS DOUBLE) / len(list_distinct(list_concat(w, (SELECT q FROM q)))), 6) AS score FROM d),
b AS (SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM s ORDER BY score DESC, id LIMIT 20),
u AS (SELECT id, 'vector' AS side, CAST(1.0 AS DOUBLE) / (60 + rank) AS s FROM a UNION ALL SELECT id, 'lexical', CAST(0.8 AS DOUBLE) / (60 + rank) FROM b)
SELECT id, round(sum(s), 9) AS score, CASE WHEN count(DISTINCT side) = 2 THEN 'hybrid' ELSE max(side) || '_only' END AS fusion_type FROM u GROUP BY id ORDER BY score DESC, id LIMIT 10"""


def _hybrid(t):
    a = _scored(t).orderBy(F.desc("score"), "id").limit(20).withColumn("payload", F.lit("vector"))
    q = F.lit(t.benchmark.where("item_id = 0").select("text").first()[0])
    b = t.documents.select(F.col("doc_id").alias("id"), F.round(tx.lexical_score(F.col("text"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(20).withColumn("payload", F.lit("lexical"))
    order = [F.desc("score"), F.col("id")]
    fused = fusion.rrf(fusion.ranked(a, 0, 1.0, order).unionByName(fusion.ranked(b, 1, 0.8, order)))
    kind = F.when(F.size("sources") == 2, "hybrid").when(F.array_contains("sources", 0), "vector_only").otherwise("lexical_only")
    return fused.select("id", "score", kind.alias("fusion_type"))


op("FUS2_vector_lexical_provenance", _HYBRID)(_hybrid)
op("FUS3_hybrid_search", _HYBRID)(_hybrid)


@op("FUS4_mmr")
def _(t):
    q = F.lit(t.benchmark.where("item_id = 0").select("text").first()[0])
    top = t.documents.select(F.lit(0).cast("long").alias("query_id"), F.col("doc_id").alias("id"), "text", F.round(tx.lexical_score(F.col("text"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return fusion.mmr(top)


@op("FUS5_rerank_blend", f"""
WITH {_V}, k AS (SELECT id, score, CAST(label AS DOUBLE) AS ce FROM v ORDER BY score DESC, id LIMIT 20)
SELECT id, round(0.7 * CASE WHEN max(ce) OVER () > min(ce) OVER () THEN (ce - min(ce) OVER ()) / (max(ce) OVER () - min(ce) OVER ()) ELSE 0.5 END + 0.3 * CASE WHEN score > 1 THEN least(score / 10, 1.0) ELSE score END, 6) AS score FROM k""")
def _(t):
    k = vectors.top_k(_vec(t), vectors.vector(t.query_vector()), 20)
    return k.select("id", F.round(fusion.blended(F.col("label").cast("double"), F.col("score"), Window.partitionBy()), 6).alias("score"))


@op("FUS8_query_expansion", "SELECT item_id, regexp_extract(lower(text), '^([a-z]+)', 1) AS verb, substr(text, 1, 20) AS head FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.regexp_extract(F.lower("text"), "^([a-z]+)", 1).alias("verb"), F.substring("text", 1, 20).alias("head"))


@op("FUS9_expansion_gate", r"SELECT item_id, len([w FOR w IN regexp_split_to_array(text, '\s+') IF w <> '']) >= 5 AS expand FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", (F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= 5).alias("expand"))


@op("FUS11_typed_search", f"WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS nr FROM v WHERE label IN (1, 2, 3)) SELECT 'type' || label AS kind, id, score FROM r WHERE nr <= 5")
def _(t):
    out, q = None, vectors.vector(t.query_vector())
    for label in (1, 2, 3):
        one = vectors.top_k(_vec(t), q, 5, where=F.col("label") == label).select(F.lit(f"type{label}").alias("kind"), "id", "score")
        out = one if out is None else out.unionByName(one)
    return out


@op("FUS12_distance_score", f"WITH {_V} SELECT id, round(1 - score, 6) AS distance, score FROM v")
def _(t):
    return _scored(t).select("id", F.round(1 - F.col("score"), 6).alias("distance"), "score")


@op("SCL3_cosine", f"WITH {_V} SELECT id, score FROM v")
def _(t):
    return _scored(t).select("id", "score")


@op("JN12_domain_after_limit", f"WITH {_V}, k AS (SELECT * FROM v ORDER BY score DESC, id LIMIT 20), f AS (SELECT * FROM k WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1) AND score >= -1) SELECT id, score FROM f ORDER BY score DESC, id LIMIT 10")
def _(t):
    hits = vectors.top_k(_vec(t), vectors.vector(t.query_vector()), 20)
    kept = hits.join(t.labels.where("quality = 1").select(F.col("doc_id").alias("id")), "id", "left_semi").where("score >= -1")
    return kept.orderBy(F.desc("score"), "id").limit(10).select("id", "score")
