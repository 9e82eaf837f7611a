"""Aggregates, windows, set operations, keyed joins and keyed writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from ..functions import text as tx
from ..operators import upserts
from .base import op


@op("AGG1_domain_counts", "SELECT n_name AS domain, count(s_suppkey) AS entities FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def _(t):
    return t.nation.join(t.supplier.where("s_acctbal > 5000"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("domain")).agg(F.count("s_suppkey").alias("entities"))


@op("AGG2_tag_counts", "SELECT p_type AS tag, count(DISTINCT l_orderkey) AS entities FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R') GROUP BY 1 ORDER BY entities DESC, tag LIMIT 50")
def _(t):
    return t.part.join(t.lineitem.where(F.col("l_returnflag").isin("A", "R")), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("tag")).agg(F.countDistinct("l_orderkey").alias("entities")).orderBy(F.desc("entities"), "tag").limit(50)


@op("AGG3_chunk_stats", "SELECT user_id AS ingestion_id, count(*) AS chunks, min(ts) AS started, min(event_type) AS first_type FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.col("user_id").alias("ingestion_id")).agg(F.count("*").alias("chunks"), F.min("ts").alias("started"), F.min("event_type").alias("first_type"))


_COUNTERS = """c AS (SELECT user_id AS ingestion_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS produced, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS received,
  max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed, bool_and(value < 90) AS complete, max(ts) AS updated FROM events GROUP BY 1)"""


def _counters(t):
    flag = lambda kind: F.when(F.col("event_type") == kind, 1).otherwise(0)
    return t.events.groupBy(F.col("user_id").alias("ingestion_id")).agg(
        F.sum(flag("view")).alias("produced"), F.sum(flag("click")).alias("received"), F.max(flag("error")).alias("failed"), F.bool_and(F.col("value") < 90).alias("complete"), F.max("ts").alias("updated")
    )


@op("AGG4_counter_pivot", f"WITH {_COUNTERS} SELECT ingestion_id, CAST(produced AS BIGINT) AS produced, CAST(received AS BIGINT) AS received, failed, complete, updated FROM c")
def _(t):
    return _counters(t)


_STATUS = "CASE WHEN failed = 1 AND NOT complete THEN 'failed' WHEN complete THEN 'completed' WHEN received > 0 THEN 'processing' ELSE 'pending' END"


@op("AGG5_status", f"WITH {_COUNTERS} SELECT ingestion_id, {_STATUS} AS status FROM c")
def _(t):
    status = F.when((F.col("failed") == 1) & ~F.col("complete"), "failed").when(F.col("complete"), "completed").when(F.col("received") > 0, "processing").otherwise("pending")
    return _counters(t).select("ingestion_id", status.alias("status"))


@op("AGG6_percentages", f"WITH {_COUNTERS} SELECT ingestion_id, CASE WHEN produced <= 0 THEN 0.0 ELSE round(least(100.0 * CAST(received AS DOUBLE) / produced, 100), 2) END AS percent FROM c")
def _(t):
    return _counters(t).select("ingestion_id", F.when(F.col("produced") <= 0, 0.0).otherwise(F.round(F.least(100.0 * F.col("received") / F.col("produced"), F.lit(100.0)), 2)).alias("percent"))


@op("AGG7_page_json", "WITH k AS (SELECT doc_id, lang FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 20) SELECT (SELECT count(*) FROM documents WHERE source = 'src3') AS total, (SELECT string_agg(doc_id || ':' || lang, ',' ORDER BY doc_id) FROM k) AS page")
def _(t):
    own = t.documents.where("source = 'src3'")
    page = own.orderBy("doc_id").limit(20).agg(F.sort_array(F.collect_list(F.struct("doc_id", "lang"))).alias("p"))
    total = own.agg(F.count("*").alias("total"))
    return total.withColumn("k", F.lit(1)).join(page.withColumn("k", F.lit(1)), "k").select("total", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["lang"])), ",").alias("page"))


@op("AGG8_counter_consistency", f"WITH {_COUNTERS} SELECT ingestion_id, produced = received AS consistent FROM c")
def _(t):
    return _counters(t).select("ingestion_id", (F.col("produced") == F.col("received")).alias("consistent"))


@op("AGG9_completion_gate", f"WITH {_COUNTERS} SELECT ingestion_id, received >= produced AND complete AS done FROM c")
def _(t):
    return _counters(t).select("ingestion_id", ((F.col("received") >= F.col("produced")) & F.col("complete")).alias("done"))


@op("AGG10_type_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@op("AGG11_tenant_counts", "SELECT c_nationkey AS company_id, count(DISTINCT c_custkey) AS files, count(DISTINCT o_orderkey) AS entities, count(DISTINCT o_orderstatus) AS kinds FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_nationkey").alias("company_id")).agg(F.countDistinct("c_custkey").alias("files"), F.countDistinct("o_orderkey").alias("entities"), F.countDistinct("o_orderstatus").alias("kinds"))


@op("AGG12_pivot_counts", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'es') AS es FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().fillna(0)


@op("AGG13_dashboard", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM supplier) AS suppliers")
def _(t):
    out = t.spark.range(1).select(F.lit(1).alias("k"))
    for name in ("documents", "pages", "events", "supplier"):
        out = out.join(getattr(t, name).agg(F.count("*").alias({"supplier": "suppliers"}.get(name, name))).withColumn("k", F.lit(1)), "k")
    return out.drop("k")


@op("AGG14_children_page", "SELECT c_custkey, count(o_orderkey) AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY c_custkey LIMIT 50 OFFSET 100")
def _(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("children")).orderBy("c_custkey").offset(100).limit(50)


@op("AGG15_collect_distinct", "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("names"))


@op("AGG16_distinct_counts", "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def _(t):
    return t.documents.agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))


@op("AGG17_label_counts", "SELECT p_type AS label, p_size AS kind, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, label, kind")
def _(t):
    return t.part.groupBy(F.col("p_type").alias("label"), F.col("p_size").alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "kind")


@op("AGG18_group_members", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


@op("AGG19_missing_properties", "SELECT count(*) FILTER (WHERE text IS NULL OR text = '') AS no_text, count(*) FILTER (WHERE lang IS NULL) AS no_lang, count(*) FILTER (WHERE n_chars < 50) AS short FROM documents")
def _(t):
    return t.documents.agg(F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("no_text"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.col("n_chars") < 50).alias("short"))


@op("AGG20_language_histogram", "WITH h AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS nr, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS total FROM h) SELECT source, lang AS primary_language, total FROM r WHERE nr = 1")
def _(t):
    h = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return h.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("primary_language"), F.sum("n").alias("total"))


@op("AGG21_dominant_extension", r"SELECT doc_id, len(regexp_extract_all(text, '\.')) AS dots, len(regexp_extract_all(text, ',')) AS commas, CASE WHEN len(regexp_extract_all(text, '\.')) >= len(regexp_extract_all(text, ',')) THEN 'dots' ELSE 'commas' END AS dominant FROM documents")
def _(t):
    a, b = F.regexp_count("text", F.lit(r"\.")).cast("long"), F.regexp_count("text", F.lit(",")).cast("long")
    return t.documents.select("doc_id", a.alias("dots"), b.alias("commas"), F.when(a >= b, "dots").otherwise("commas").alias("dominant"))


@op("AGG22_distinct_rows", "SELECT DISTINCT event_type, user_id FROM events")
def _(t):
    return t.events.select("event_type", "user_id").distinct()


@op("AGG23_eta", "SELECT user_id, round((100 - count(*)) / (CAST(count(*) AS DOUBLE) / 10), 3) AS eta FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.round((100 - F.count("*")) / (F.count("*") / 10), 3).alias("eta"))


@op("WIN1_cascade_dedup", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS nr FROM documents) SELECT source, doc_id, n_chars FROM r WHERE nr = 1")
def _(t):
    return t.documents.withColumn("nr", F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id"))).where("nr = 1").select("source", "doc_id", "n_chars")


@op("WIN2_page_total", "SELECT doc_id, count(*) OVER () AS total FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 20 OFFSET 10")
def _(t):
    return t.documents.where("lang = 'fr'").select("doc_id", F.count("*").over(Window.partitionBy()).alias("total")).orderBy("doc_id").offset(10).limit(20)


@op("WIN3_list_rank", "SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INT) AS rank FROM events")
def _(t):
    return t.events.select("event_type", "event_id", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).alias("rank"))


@op("WIN4_latest_version", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(t):
    return t.events.where("event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@op("WIN5_next_version", "SELECT user_id, coalesce(max(event_id), 0) + 1 AS next FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg((F.coalesce(F.max("event_id"), F.lit(0)) + 1).alias("next"))


@op("WIN6_turn_index", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS chunk_index, count(*) OVER (PARTITION BY conv_id) AS total_chunks FROM conversations")
def _(t):
    w = Window.partitionBy("conv_id")
    return t.conversations.select("conv_id", "turn", (F.row_number().over(w.orderBy("turn")) - 1).alias("chunk_index"), F.count("*").over(w).alias("total_chunks"))


@op("WIN7_min_max", "SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.5 END, 6) AS score FROM events WINDOW w AS (PARTITION BY event_type)")
def _(t):
    from ..operators.fusion import min_max

    return t.events.select("event_id", F.round(min_max(F.col("value"), Window.partitionBy("event_type")), 6).alias("score"))


@op("WIN8_last_write_wins", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nr FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE nr = 1")
def _(t):
    return upserts.latest(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@op("WIN9_specificity", "SELECT doc_id, CASE source WHEN 'src1' THEN 0 WHEN 'src2' THEN 1 WHEN 'src3' THEN 2 ELSE 3 END AS specificity FROM documents ORDER BY specificity, doc_id LIMIT 100")
def _(t):
    return specificity(t.documents).limit(100)


def specificity(documents):
    """All documents, the most specific first."""
    s = F.col("source")
    return documents.select("doc_id", F.when(s == "src1", 0).when(s == "src2", 1).when(s == "src3", 2).otherwise(3).alias("specificity")).orderBy("specificity", "doc_id")


@op("WIN9_specificity_all", "SELECT doc_id, CASE source WHEN 'src1' THEN 0 WHEN 'src2' THEN 1 WHEN 'src3' THEN 2 ELSE 3 END AS specificity FROM documents ORDER BY specificity, doc_id")
def _(t):
    return specificity(t.documents)


@op("SET1_optional_branches", "SELECT r_name AS name, 'region' AS kind FROM region UNION ALL SELECT n_name, 'nation' FROM nation")
def _(t):
    return t.region.select(F.col("r_name").alias("name"), F.lit("region").alias("kind")).unionByName(t.nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")))


@op("SET2_ranked_union", "SELECT doc_id AS id, 0 AS list_idx FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 1 FROM labels WHERE quality = 1")
def _(t):
    return t.documents.where("lang = 'de'").select(F.col("doc_id").alias("id"), F.lit(0).alias("list_idx")).unionByName(t.labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(1).alias("list_idx")))


@op("SET3_upsert_split", "WITH k AS (SELECT DISTINCT lower(p_name) AS key FROM part), e AS (SELECT DISTINCT lower(p_name) AS key FROM part WHERE p_size < 10) SELECT key, key IN (SELECT key FROM e) AS known FROM k")
def _(t):
    k, e = (x.select(F.lower("p_name").alias("key")).distinct() for x in (t.part, t.part.where("p_size < 10")))
    return k.join(e, "key", "left_semi").withColumn("known", F.lit(True)).unionByName(k.join(e, "key", "left_anti").withColumn("known", F.lit(False)))


@op("SET4_token_overlap", r"WITH w AS (SELECT item_id, list_distinct([x FOR x IN regexp_split_to_array(lower(text), '\s+') IF x <> '']) AS t FROM benchmark) SELECT a.item_id, len(list_intersect(a.t, b.t)) AS shared, len(list_distinct(list_concat(a.t, b.t))) AS either FROM w a JOIN w b ON b.item_id = a.item_id + 1")
def _(t):
    w = t.benchmark.select("item_id", tx.token_set(F.col("text")).alias("t"))
    b = w.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return w.join(b, "item_id").select("item_id", F.size(F.array_intersect("t", "u")).cast("long").alias("shared"), F.size(F.array_union("t", "u")).cast("long").alias("either"))


@op("SET6_alias_union", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS aliases FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.sort_array(F.array_distinct(F.collect_list("p_type"))), ",").alias("aliases"))


@op("JN1_entries_in_scope", "SELECT conv_id, turn, d.source FROM conversations JOIN documents d ON d.doc_id = conv_id WHERE d.source = 'src5'")
def _(t):
    return t.conversations.join(t.documents.where("source = 'src5'"), F.col("doc_id") == F.col("conv_id")).select("conv_id", "turn", "source")


@op("JN2_stats_left_join", "WITH a AS (SELECT source, count(*) AS chunks FROM documents GROUP BY 1), b AS (SELECT source, count(*) AS labelled FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) SELECT a.source, chunks, labelled FROM a LEFT JOIN b USING (source)")
def _(t):
    b = t.documents.join(t.labels.where("toxic = 1"), "doc_id").groupBy("source").agg(F.count("*").alias("labelled"))
    return t.documents.groupBy("source").agg(F.count("*").alias("chunks")).join(b, "source", "left")


@op("JN14_first_match", "SELECT l.doc_id, d.lang FROM labels l LEFT JOIN (SELECT doc_id, min(lang) AS lang FROM documents GROUP BY 1) d USING (doc_id)")
def _(t):
    return t.labels.select("doc_id").join(t.documents.groupBy("doc_id").agg(F.min("lang").alias("lang")), "doc_id", "left")


@op("JN15_optional_enrichment", "SELECT p_partkey, coalesce(nullif(p_name, ''), p_type) AS name, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) AS suppliers FROM part")
def _(t):
    s = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("suppliers"))
    return t.part.join(s, "p_partkey", "left").select("p_partkey", F.coalesce(F.nullif("p_name", F.lit("")), "p_type").alias("name"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@op("JN16_edge_backfill", "SELECT l.doc_id, 'summarizes' AS rel FROM labels l JOIN documents d USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = l.doc_id)")
def _(t):
    return t.labels.join(t.documents, "doc_id", "left_semi").join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left_anti").select("doc_id", F.lit("summarizes").alias("rel"))


@op("JN17_graph_survival", "SELECT p_partkey FROM part a WHERE p_size < 25 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_name = a.p_name AND b.p_type = a.p_type AND b.p_size >= 25)")
def _(t):
    kept = t.part.where("p_size >= 25").select("p_name", "p_type").distinct()
    return t.part.where("p_size < 25").join(kept, ["p_name", "p_type"], "left_anti").select("p_partkey")


@op("JN18_vector_survival", "SELECT p_partkey FROM part a WHERE p_size >= 25 OR p_name IN (SELECT p_name FROM part WHERE p_size >= 25)")
def _(t):
    return upserts.surviving(t.part, t.part.where("p_size < 25").select("p_size").distinct(), "p_name", "p_size").select("p_partkey")


@op("JN19_orphans_after_delete", "SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING bool_and(l_partkey % 2 = 0)")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.bool_and(F.col("l_partkey") % 2 == 0).alias("gone")).where("gone").select("l_suppkey")


@op("JN20_integrity", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@op("JN28_exists_filter", "SELECT event_id FROM events WHERE user_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(t):
    return t.events.join(t.labels.where("quality = 0").select(F.col("doc_id").alias("user_id")), "user_id", "left_semi").select("event_id")


@op("JN31_membership_counts", "SELECT n_name, count(DISTINCT o_custkey) AS members FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    return t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).join(t.orders, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.countDistinct("o_custkey").alias("members"))


@op("SNK1_vector_upsert", "WITH u AS (SELECT user_id, max_by(value, (ts, event_id)) AS value FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, max_by(value, (ts, event_id)) AS value FROM events WHERE event_type = 'view' GROUP BY 1) SELECT user_id, value FROM u UNION ALL SELECT user_id, value FROM b WHERE user_id NOT IN (SELECT user_id FROM u)")
def _(t):
    e = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    base = upserts.latest(e.where("event_type = 'view'"), ["user_id"], ["ts", "event_id"])
    return upserts.upsert(base, e.where("event_type = 'click'"), ["user_id"], ["ts", "event_id"]).select("user_id", "value")


@op("SNK3_merge_nodes", "SELECT coalesce(a.doc_id, l.doc_id) AS id, a.lang AS created, CASE WHEN l.doc_id IS NOT NULL AND l.quality IS NOT NULL THEN l.quality ELSE a.q END AS quality FROM (SELECT doc_id, lang, 5 AS q FROM documents WHERE lang = 'en') a FULL JOIN labels l USING (doc_id)")
def _(t):
    target = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("lang").alias("created"), F.lit(5).alias("quality"))
    updates = t.labels.select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("created"), "quality")
    return upserts.merge_nodes(target, updates, "id", ["quality"])


@op("SNK6_counters", "SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS counter_value FROM events GROUP BY 1, 2")
def _(t):
    rows = t.events.select("user_id", "event_type", F.lit(1).cast("long").alias("counter_value"), "ts")
    return upserts.add_counters(rows.where("ts < timestamp'2024-01-08'"), rows.where("ts >= timestamp'2024-01-08'"), ["user_id", "event_type"])


@op("SNK7_checkpoints", "SELECT user_id AS item_id, event_type AS stage, max_by(md5(props), (ts, event_id)) AS content_hash FROM events GROUP BY 1, 2")
def _(t):
    e = t.events.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("stage"), F.md5("props").alias("content_hash"), "ts", "event_id")
    return upserts.latest(e, ["item_id", "stage"], ["ts", "event_id"]).select("item_id", "stage", "content_hash")


@op("SNK9_file_versions", "WITH s AS (SELECT source, sha256(text) AS h FROM documents WHERE lang = 'en'), v AS (SELECT source, count(*) AS last FROM s GROUP BY 1), c AS (SELECT DISTINCT source, sha256(text) AS h FROM documents WHERE lang <> 'en'), f AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source = c.source AND s.h = c.h)) SELECT f.source, f.h AS content_hash, coalesce(last, 0) + row_number() OVER (PARTITION BY f.source ORDER BY f.h) AS version FROM f LEFT JOIN v USING (source)")
def _(t):
    d = t.documents.select("source", "lang", F.sha2("text", 256).alias("content_hash"))
    stored = d.where("lang = 'en'").select("source", "content_hash").withColumn("version", F.count("*").over(Window.partitionBy("source")))
    return upserts.record_versions(stored, d.where("lang <> 'en'").select("source", "content_hash").distinct(), ["source"])


@op("SNK10_rebuild_files", "SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS content_hash FROM conversations GROUP BY 1")
def _(t):
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    return t.conversations.groupBy("conv_id").agg(F.sha2(whole, 256).alias("content_hash"))


@op("SNK11_run_stats", "SELECT user_id, count(*) AS consumed, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type <> 'error') AS processed FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("consumed"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") != "error").alias("processed"))


@op("SNK12_delete_by_filter", "SELECT count(*) FILTER (WHERE lang = 'de') AS deleted, count(*) FILTER (WHERE lang <> 'de') AS kept FROM documents")
def _(t):
    return t.documents.agg(F.count_if(F.col("lang") == "de").alias("deleted"), F.count_if(F.col("lang") != "de").alias("kept"))


@op("SNK13_move_tenant", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'src2' ELSE source END AS source FROM documents")
def _(t):
    return t.documents.select("doc_id", F.when(F.col("source") == "src1", "src2").otherwise(F.col("source")).alias("source"))


@op("REL1_correlated_counts", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def _(t):
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return t.nation.select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").fillna(0)


@op("REL2_name_exists", "SELECT a.doc_id, EXISTS (SELECT 1 FROM documents b WHERE b.n_chars = a.n_chars AND nullif(b.lang, 'es') IS NOT DISTINCT FROM nullif(a.lang, 'es') AND b.doc_id <> a.doc_id) AS taken FROM documents a")
def _(t):
    d = t.documents.select("doc_id", "n_chars", F.nullif("lang", F.lit("es")).alias("scope"))
    return d.withColumn("taken", F.count("*").over(Window.partitionBy("n_chars", "scope")) > 1).select("doc_id", "taken")


@op("REL3_duplicates_by_hash", "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY lang, md5(text)) AS n FROM documents) WHERE n > 1 UNION ALL SELECT -1")
def _(t):
    d = t.documents.withColumn("n", F.count("*").over(Window.partitionBy("lang", F.md5("text")))).where("n > 1").select("doc_id")
    return d.union(t.spark.range(1).select(F.lit(-1).cast("long")))


@op("REL4_directories", "WITH p AS (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages), e AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM p) SELECT DISTINCT array_to_string(parts[1:i], '/') AS path, CAST(i AS INT) AS depth FROM e")
def _(t):
    p = t.pages.select(F.split(F.regexp_replace("url", "^https?://", ""), "/").alias("parts")).select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    return p.select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path"), "depth").distinct()


@op("REL6_json_key", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '10' OR event_type = 'error'")
def _(t):
    return t.events.where((F.get_json_object("props", "$.k") == "10") | (F.col("event_type") == "error")).select("event_id")


@op("REL8_progress_deltas", "SELECT user_id, round(sum(value), 4) AS total, max_by(event_type, (ts, event_id)) AS current FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.max_by("event_type", F.struct("ts", "event_id")).alias("current"))


@op("REL11_slug_lookup", "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_ -]', '', 'g'), '[ _]+', '-', 'g'), ''), CAST(p_partkey AS VARCHAR)) AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", F.coalesce(F.nullif(tx.slugify(F.col("p_name")), F.lit("")), F.col("p_partkey").cast("string")).alias("slug"))


@op("FLT10_visibility", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR (c_acctbal > 0 AND c_mktsegment = 'BUILDING') OR (c_acctbal > 0 AND c_nationkey IN (1, 2))")
def _(t):
    public = F.col("c_acctbal") > 0
    return t.customer.where((F.col("c_nationkey") == 3) | (public & (F.col("c_mktsegment") == "BUILDING")) | (public & F.col("c_nationkey").isin(1, 2))).select("c_custkey")


_FILE_RULES = r"CASE WHEN strlen(html) > 60000 THEN 'too_large' WHEN contains(url, 'spam') THEN 'name' WHEN NOT regexp_matches(url, '\.[a-z]+$') THEN 'no_extension' WHEN NOT suffix(url, '.html') THEN 'extension' ELSE 'ok' END"


def _file_rule():
    return F.when(F.octet_length("html") > 60000, "too_large").when(F.col("url").contains("spam"), "name").when(~F.col("url").rlike(r"\.[a-z]+$"), "no_extension").when(~F.col("url").endswith(".html"), "extension").otherwise("ok")


@op("FLT11_file_filter", f"SELECT page_id, {_FILE_RULES} AS reason FROM pages")
def _(t):
    return t.pages.select("page_id", _file_rule().alias("reason"))


@op("FLT12_filter_stats", f"SELECT {_FILE_RULES} AS reason, count(*) AS n FROM pages GROUP BY 1")
def _(t):
    return t.pages.groupBy(_file_rule().alias("reason")).agg(F.count("*").alias("n"))


@op("FLT17_row_validation", "SELECT doc_id, CASE WHEN (lang = 'en') = (source <> 'src0') THEN 'valid' ELSE 'rejected' END AS verdict FROM documents")
def _(t):
    return t.documents.select("doc_id", F.when((F.col("lang") == "en") == (F.col("source") != "src0"), "valid").otherwise("rejected").alias("verdict"))


@op("FLT21_dual_tenant", "SELECT lang, source, count(*) AS n FROM documents WHERE lang = 'en' AND source = 'src2' GROUP BY 1, 2")
def _(t):
    return t.documents.where("lang = 'en' and source = 'src2'").groupBy("lang", "source").agg(F.count("*").alias("n"))


@op("FLT22_scope_key", "SELECT doc_id, CASE WHEN lang = 'en' THEN source || '_knowledge' WHEN lang = 'de' THEN source || '_' || lang || '_code' END AS scope FROM documents")
def _(t):
    return t.documents.select("doc_id", F.when(F.col("lang") == "en", F.concat("source", F.lit("_knowledge"))).when(F.col("lang") == "de", F.concat_ws("_", "source", "lang", F.lit("code"))).alias("scope"))


@op("SRC2_change_lines", r"WITH l AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'M' || chr(9) || 'a/' || doc_id WHEN 1 THEN 'R100' || chr(9) || 'old/' || doc_id || chr(9) || 'new/' || doc_id ELSE 'D' || chr(9) || 'b/' || doc_id END AS line FROM documents), s AS (SELECT doc_id, string_split(line, chr(9)) AS p FROM l) SELECT doc_id, CASE WHEN starts_with(p[1], 'R') THEN 'R' ELSE p[1] END AS change_type, CASE WHEN starts_with(p[1], 'R') THEN p[3] ELSE p[2] END AS file_path, CASE WHEN starts_with(p[1], 'R') THEN p[2] END AS previous_path FROM s")
def _(t):
    from ..sources.files import parse_changes

    i, m = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    line = F.when(m == 0, F.concat(F.lit("M\ta/"), i)).when(m == 1, F.concat(F.lit("R100\told/"), i, F.lit("\tnew/"), i)).otherwise(F.concat(F.lit("D\tb/"), i))
    return parse_changes(t.documents.select("doc_id", line.alias("value"))).select("doc_id", "change_type", "file_path", "previous_path")


@op("SRC5_language", "SELECT page_id, CASE WHEN suffix(url, '.html') THEN 'html' ELSE 'unknown' END AS language FROM pages WHERE NOT regexp_matches(url, '\\.(com|net|org|py|js)$')")
def _(t):
    return t.pages.where(~F.col("url").rlike(r"\.(com|net|org|py|js)$")).select("page_id", tx.language(F.col("url")).alias("language"))


@op("SRC5_language_all", f"SELECT page_id, {tx.by_extension_sql('url', tx.DOCUMENT_LANGUAGES)} AS document_language, {tx.by_extension_sql('url', tx.CODE_LANGUAGES, tx.AFTER_LAST_DOT)} AS code_language, {tx.by_extension_sql('url', tx.EVENT_LANGUAGES, default=None)} AS event_language FROM pages")
def _(t):
    url = F.col("url")
    return t.pages.select("page_id", tx.document_language(url).alias("document_language"), tx.code_language(url).alias("code_language"), tx.event_language(url).alias("event_language"))


@op("SRC8_paged_scan", "SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 40 OFFSET 80")
def _(t):
    return t.embeddings.where("embedding is not null").select("vec_id").orderBy("vec_id").offset(80).limit(40)


@op("SRC10_filtered_scan", "SELECT vec_id, label FROM embeddings WHERE label = 4")
def _(t):
    return t.embeddings.where("label = 4").select("vec_id", "label")


@op("SRC11_directories", "SELECT DISTINCT regexp_replace(url, '/[^/]+$', '') AS directory FROM pages ORDER BY 1")
def _(t):
    return t.pages.select(F.regexp_replace("url", "/[^/]+$", "").alias("directory")).distinct().orderBy("directory")


@op("STR15_flush_last_use", "SELECT user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("user_id", F.floor(F.unix_timestamp("ts") / 60).alias("minute")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@op("STR14_latency_histogram", "SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("event_type", F.floor(F.col("value") / 10).alias("bucket")).agg(F.count("*").alias("n"))



