"""Keyed writes by kind, graph building and record lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import metadata as md
from ..functions import text as tx
from ..operators import extraction, symbols, upserts
from .base import GRAPH_SQL, op


def _uuid5(x: str) -> str:
    """SQL of functions.ids.uuid5 under the namespace of object ids."""
    h = f"sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({x}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || printf('%02x', (CAST('0x' || substr({h}, 17, 2) AS INT) & 63) | 128) || substr({h}, 19, 2) || '-' || substr({h}, 21, 12))"


def _s(prefix: str, key):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


# --- writes ---

_KINDS_SQL = f"""
k AS (SELECT 'chunk' AS kind, 'd' || doc_id AS id, source AS scope, text AS payload FROM documents
  UNION ALL SELECT 'entity', id, scope, name FROM nodes
  UNION ALL SELECT 'entity_type', label, 'all', label FROM nodes
  UNION ALL SELECT 'edge_type', rel, 'all', rel FROM edges
  UNION ALL SELECT 'triplet', src || '|' || rel || '|' || dst, 'all', src || '-›' || rel || '-›' || dst FROM edges)"""


@op("SNK2_upserts_by_kind", f"WITH {GRAPH_SQL}, {_KINDS_SQL} SELECT DISTINCT kind, id, coalesce(scope, 'none') AS scope, md5(payload) AS payload FROM k WHERE id IS NOT NULL AND payload IS NOT NULL AND payload <> ''")
def _(t):
    n, e = t.nodes(), t.edges()
    k = t.documents.select(F.lit("chunk").alias("kind"), _s("d", "doc_id").alias("id"), F.col("source").alias("scope"), F.col("text").alias("payload"))
    k = k.unionByName(n.select(F.lit("entity").alias("kind"), "id", "scope", F.col("name").alias("payload")))
    k = k.unionByName(n.select(F.lit("entity_type").alias("kind"), F.col("label").alias("id"), F.lit("all").alias("scope"), F.col("label").alias("payload")))
    k = k.unionByName(e.select(F.lit("edge_type").alias("kind"), F.col("rel").alias("id"), F.lit("all").alias("scope"), F.col("rel").alias("payload")))
    k = k.unionByName(e.select(F.lit("triplet").alias("kind"), F.concat_ws("|", "src", "rel", "dst").alias("id"), F.lit("all").alias("scope"), tx.triplet_text(F.col("src"), F.col("rel"), F.col("dst")).alias("payload")))
    return k.where("id is not null and payload <> ''").select("kind", "id", F.coalesce("scope", F.lit("none")).alias("scope"), F.md5("payload").alias("payload")).distinct()


@op("SNK4_merge_edges", f"""
WITH {GRAPH_SQL}, have AS (SELECT src, rel, dst, 'kept' AS what FROM edges WHERE rel = 'in_nation'),
want AS (SELECT src, rel, dst FROM edges UNION ALL SELECT src, rel, dst FROM edges UNION ALL SELECT id, 'in_nation', 'n99' FROM nodes WHERE label = 'supplier')
SELECT * FROM have UNION ALL SELECT DISTINCT src, rel, dst, 'new' FROM want WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) AND NOT EXISTS (SELECT 1 FROM have h WHERE h.src = want.src AND h.rel = want.rel AND h.dst = want.dst)""")
def _(t):
    e, n = t.edges(), t.nodes()
    have = e.where("rel = 'in_nation'")
    want = e.unionByName(e).unionByName(n.where("label = 'supplier'").select(F.col("id").alias("src"), F.lit("in_nation").alias("rel"), F.lit("n99").alias("dst")))
    return upserts.merge_edges(have, want, n)


@op("SNK8_staged_chunks", "WITH s AS (SELECT 'c' || (doc_id % 50) AS chunk_id, doc_id AS seq, n_chars FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC) AS nr FROM s) SELECT chunk_id, seq, n_chars FROM r WHERE nr = 1")
def _(t):
    staged = t.documents.select(F.concat(F.lit("c"), (F.col("doc_id") % 50).cast("string")).alias("chunk_id"), F.col("doc_id").alias("seq"), "n_chars")
    return upserts.upsert(staged.limit(0), staged, ["chunk_id"], ["seq"])


@op("SNK14_tenant_transfer", """
SELECT 'supplier' AS tbl, count(*) FILTER (s_nationkey = 3) AS moved, count(*) FILTER (s_nationkey IN (3, 7)) AS at_target FROM supplier
UNION ALL SELECT 'customer', count(*) FILTER (c_nationkey = 3), count(*) FILTER (c_nationkey IN (3, 7)) FROM customer""")
def _(t):
    out = None
    for name, key in (("supplier", "s_nationkey"), ("customer", "c_nationkey")):
        moved = upserts.moved_tenant(getattr(t, name), key, 3, 7)
        part = moved.agg(F.count_if(F.col("moved")).alias("moved"), F.count_if(F.col(key) == 7).alias("at_target")).select(F.lit(name).alias("tbl"), "moved", "at_target")
        out = part if out is None else out.unionByName(part)
    return out


# --- graph building ---


@op("SCL1_uuid5", f"WITH {GRAPH_SQL} SELECT id, {_uuid5("replace(replace(lower(name), ' ', '_'), chr(39), '')")} AS uuid FROM nodes")
def _(t):
    return t.nodes().select("id", ids.graph_id(F.col("name")).alias("uuid"))


@op("GRB2_summaries", f"""
WITH d AS (SELECT doc_id, source, {_uuid5("'summary:' || doc_id")} AS sid FROM documents WHERE coalesce(text, '') <> '')
SELECT sid AS src, 'summarizes' AS rel, 'd' || doc_id AS dst FROM d UNION ALL SELECT sid, 'made_from', 'd' || doc_id FROM d UNION ALL SELECT sid, 'is_part_of', source FROM d WHERE source IS NOT NULL""")
def _(t):
    d = t.documents.where("text <> ''").select("source", _s("d", "doc_id").alias("chunk"), ids.uuid5(_s("summary:", "doc_id")).alias("src"))
    edge = lambda rel, dst: F.struct(F.lit(rel).alias("rel"), F.col(dst).alias("dst"))
    return d.select("src", F.explode(F.array(edge("summarizes", "chunk"), edge("made_from", "chunk"), edge("is_part_of", "source"))).alias("e")).select("src", "e.rel", "e.dst").where("dst is not null")


@op("GRB3b_repositories", f"""
WITH c AS (SELECT source || ':' || lang AS scope, doc_id FROM documents WHERE lang <> 'fr' AND source IS NOT NULL), r AS (SELECT scope, min(doc_id) AS first FROM c GROUP BY 1)
SELECT {_uuid5("'repo:' || scope")} AS id, scope, CAST(first AS VARCHAR) AS other, 'node' AS what FROM r UNION ALL SELECT 'd' || doc_id, scope, {_uuid5("'repo:' || scope")}, 'is_part_of' FROM c""")
def _(t):
    c = t.documents.where("lang <> 'fr' and source is not null").select(F.concat_ws(":", "source", "lang").alias("scope"), "doc_id")
    repo = ids.uuid5(F.concat(F.lit("repo:"), F.col("scope")))
    nodes = c.groupBy("scope").agg(F.min("doc_id").cast("string").alias("other")).select(repo.alias("id"), "scope", "other", F.lit("node").alias("what"))
    return nodes.unionByName(c.select(_s("d", "doc_id").alias("id"), "scope", repo.alias("other"), F.lit("is_part_of").alias("what")))


_STEM_SQL = "CASE WHEN w LIKE '%tion' AND length(w) >= 8 THEN left(w, length(w) - 4) WHEN w LIKE '%ment' AND length(w) >= 8 THEN left(w, length(w) - 4) WHEN w LIKE '%ing' AND length(w) >= 7 THEN left(w, length(w) - 3) WHEN w LIKE '%s' AND length(w) >= 5 THEN left(w, length(w) - 1) ELSE w END"
_CAMEL = r"regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"


def _domain_key(x: str) -> str:
    return f"array_to_string(list_sort([{_STEM_SQL} FOR w IN regexp_extract_all(lower({_CAMEL.format(x)}), '[a-z]+')]), '_')"


@op("TXT5_domain_key_letters", f"SELECT p_partkey, {_domain_key('p_name || p_partkey || p_type')} AS key FROM part")
def _(t):
    return t.part.select("p_partkey", tx.domain_key(F.concat(F.col("p_name"), F.col("p_partkey").cast("string"), F.col("p_type"))).alias("key"))


@op("GRB3e_domains", f"""
WITH b AS (SELECT p_brand AS parent, {_domain_key('p_name')} AS key FROM part), x AS (SELECT p_brand || '/' || p_type AS parent, lower(p_name) AS key FROM part)
SELECT DISTINCT 'business' AS kind, {_uuid5("'business:' || parent || ':' || key")} AS id, key, parent FROM b WHERE key <> '' UNION ALL SELECT DISTINCT 'technical', {_uuid5("'technical:' || parent || ':' || key")}, key, parent FROM x""")
def _(t):
    b = t.part.select(F.lit("business").alias("kind"), F.col("p_brand").alias("parent"), tx.domain_key(F.col("p_name")).alias("key"))
    x = t.part.select(F.lit("technical").alias("kind"), F.concat_ws("/", "p_brand", "p_type").alias("parent"), F.lower("p_name").alias("key"))
    return b.unionByName(x).where("key <> ''").distinct().select("kind", ids.uuid5(F.concat_ws(":", "kind", "parent", "key")).alias("id"), "key", "parent")


@op("GRB3f_code_blocks", f"""
WITH x AS (SELECT l_partkey AS entity, l_orderkey % 20 AS version, min(l_linenumber) AS start_line, max(l_linenumber) AS end_line FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, {_uuid5("'block:' || entity || ':' || version")} AS id FROM x)
SELECT 'p' || entity AS src, 'has_code' AS rel, id AS dst, start_line, end_line FROM b UNION ALL SELECT 'branch' || version, 'has_code_block', id, start_line, end_line FROM b""")
def _(t):
    x = t.lineitem.groupBy(F.col("l_partkey").alias("entity"), (F.col("l_orderkey") % 20).alias("version")).agg(F.min("l_linenumber").alias("start_line"), F.max("l_linenumber").alias("end_line"))
    x = x.withColumn("dst", ids.uuid5(F.concat_ws(":", F.lit("block"), F.col("entity").cast("string"), F.col("version").cast("string"))))
    ends = F.array(F.struct(_s("p", "entity").alias("src"), F.lit("has_code").alias("rel")), F.struct(_s("branch", "version").alias("src"), F.lit("has_code_block").alias("rel")))
    return x.select(F.explode(ends).alias("e"), "dst", "start_line", "end_line").select("e.src", "e.rel", "dst", "start_line", "end_line")


_EVENT_SQL = """
ev AS (SELECT p_partkey AS id, p_type AS event, p_name AS name FROM part), ed AS (SELECT a.id AS src, 'beside' AS rel, a.id + 1 AS dst, a.event FROM ev a)"""


@op("CHK11_event_items", f"""
WITH {_EVENT_SQL}, i AS (
  SELECT 'entity' AS kind, CAST(id AS VARCHAR) AS id, name AS text FROM ev WHERE name <> ''
  UNION ALL SELECT 'triplet', {_uuid5("CAST(src AS VARCHAR) || rel || dst")}, a.name || '-›' || rel || '-›' || b.name FROM ed JOIN ev a ON a.id = src JOIN ev b ON b.id = dst AND b.event = ed.event
  UNION ALL SELECT DISTINCT 'edge_type', {_uuid5("rel")}, rel FROM ed UNION ALL SELECT DISTINCT 'entity_type', {_uuid5("lower(event)")}, event FROM ev)
SELECT kind, id, text FROM i""")
def _(t):
    ev = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("event"), F.col("p_name").alias("name"))
    ed = ev.select(F.col("id").alias("src"), F.lit("beside").alias("rel"), (F.col("id") + 1).alias("dst"), "event")
    named = lambda end: ev.select(F.col("id").alias(end), "event", F.col("name").alias(f"{end}_name"))
    both = ed.join(named("src"), ["src", "event"]).join(named("dst"), ["dst", "event"])
    item = lambda df, kind, key, text: df.select(F.lit(kind).alias("kind"), key.alias("id"), text.alias("text"))
    out = item(ev, "entity", F.col("id").cast("string"), F.col("name"))
    out = out.unionByName(item(both, "triplet", ids.uuid5(F.concat(F.col("src").cast("string"), F.col("rel"), F.col("dst").cast("string"))), tx.triplet_text(F.col("src_name"), F.col("rel"), F.col("dst_name"))))
    out = out.unionByName(item(ed.select("rel").distinct(), "edge_type", ids.graph_id(F.col("rel")), F.col("rel")))
    out = out.unionByName(item(ev.select("event").distinct(), "entity_type", ids.graph_id(F.col("event")), F.col("event")))
    return out.where("id <> '' and text <> ''")


@op("GRB8_prompts", """
SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN nullif(replace(replace(CASE p_size % 4 WHEN 1 THEN 'Extract {{ENTITY_TYPE}} of {{DOCUMENT_TITLE}}' WHEN 2 THEN '' END, '{{ENTITY_TYPE}}', p_type), '{{DOCUMENT_TITLE}}', p_name), '')
  ELSE replace(replace('All {{ENTITY_TYPE}} in {{DOCUMENT_TITLE}}', '{{ENTITY_TYPE}}', p_type), '{{DOCUMENT_TITLE}}', p_name) END AS prompt FROM part""")
def _(t):
    m = F.col("p_size") % 4
    given = F.when(m == 1, "Extract {{ENTITY_TYPE}} of {{DOCUMENT_TITLE}}").when(m == 2, "")
    return t.part.select("p_partkey", md.prompt(m != 0, given, F.lit("All {{ENTITY_TYPE}} in {{DOCUMENT_TITLE}}"), {"ENTITY_TYPE": F.col("p_type"), "DOCUMENT_TITLE": F.col("p_name")}).alias("prompt"))


@op("GRB10_index_points", """
WITH f AS (SELECT 'part' AS type, 'p_name' AS field, p_partkey AS id, p_name AS text FROM part UNION ALL SELECT 'part', 'p_brand', p_partkey, nullif(p_brand, 'Brand#2') FROM part)
SELECT type, field, count(*) AS points, count(DISTINCT text) AS texts FROM f WHERE text IS NOT NULL GROUP BY 1, 2""")
def _(t):
    field = lambda name, c: F.struct(F.lit(name).alias("field"), c.alias("text"))
    points = t.part.select(F.lit("part").alias("type"), F.explode(F.array(field("p_name", F.col("p_name")), field("p_brand", F.nullif("p_brand", F.lit("Brand#2"))))).alias("f")).select("type", "f.field", "f.text")
    return points.where("text is not null").groupBy("type", "field").agg(F.count("*").alias("points"), F.countDistinct("text").alias("texts"))


# --- texts and metadata ---


@op("TXT15_symbol_match")
def _(t):
    p = F.col("p_size") % 4
    wanted = F.when(p == 0, F.col("p_name")).when(p == 1, F.upper("p_name")).when(p == 2, F.concat("p_name", F.lit("s"))).otherwise(F.reverse("p_name"))
    rows = t.part.where("p_type is not null").select("p_partkey", F.col("p_type").alias("file"), wanted.alias("wanted"), "p_name")
    found = symbols.matched(rows.select("file", "wanted"), rows.select("file", F.col("p_name").alias("name")))
    return rows.join(found, ["file", "wanted"], "left").select("p_partkey", "wanted", "symbol")


@op("TXT16_content_type", r"""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '_spec.rb' WHEN 1 THEN 'spec\' || url WHEN 2 THEN url || '/spec/x.rb' ELSE url END AS path, list_extract(['Ruby', 'JavaScript', ' python ', 'Rust', NULL], CAST(page_id % 5 AS INT) + 1) AS lang FROM pages WHERE url IS NOT NULL),
l AS (SELECT page_id, replace(path, '\', '/') AS path, lower(trim(coalesce(lang, ''))) AS lang FROM p)
SELECT page_id, CASE WHEN lang = 'ruby' AND (suffix(path, '_spec.rb') OR suffix(path, '_test.rb') OR contains(path, '/spec/') OR starts_with(path, 'spec/')) THEN 'ruby_spec' WHEN lang = 'ruby' THEN 'ruby_rails' WHEN lang = 'javascript' THEN 'typescript' ELSE lang END AS content_type FROM l""")
def _(t):
    p = F.col("page_id") % 4
    path = F.when(p == 0, F.concat("url", F.lit("_spec.rb"))).when(p == 1, F.concat(F.lit("spec\\"), F.col("url"))).when(p == 2, F.concat("url", F.lit("/spec/x.rb"))).otherwise(F.col("url"))
    lang = F.get(F.array(*[F.lit(x) for x in ("Ruby", "JavaScript", " python ", "Rust", None)]), (F.col("page_id") % 5).cast("int"))
    return t.pages.where("url is not null").select("page_id", md.content_type(path, lang).alias("content_type"))


@op("TXT21_pascalize", f"SELECT item_id, array_to_string([upper(w[1:1]) || w[2:] FOR w IN regexp_extract_all(text, '[A-Za-z0-9]+') IF lower(w) NOT IN ({', '.join(repr(w) for w in tx.EXPANSION_STOP_WORDS)})], '') AS name FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", tx.pascalize(F.col("text")).alias("name"))


def _purpose_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '{'|'.join(words)}') THEN '{what}'" for words, what in md.PURPOSES) + f" ELSE '{md.OTHER_PURPOSE}' END"


def _keywords_sql(x: str) -> str:
    return f"([k FOR k IN [{', '.join(repr(k) for k in md.KEYWORDS)}] IF contains(lower(coalesce({x}, '')), k)])[1:5]"


_SYMBOLS = ("validateOrder", "formatUser", "onHandle", "getToken", "saveCart", "findEmail", "computeTax", "main")
_SYM_SQL = f"""
sym AS (SELECT event_id, list_extract({list(_SYMBOLS)!r}, CAST(event_id % 8 AS INT) + 1) AS name, list_extract(['nested_function', 'try_catch', 'class', 'rescue_block'], CAST(event_id % 4 AS INT) + 1) AS kind,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE 'handles ' || event_type END AS parent, event_type || ' order user token ' || props || list_extract({list(_SYMBOLS)!r}, CAST(event_id % 8 AS INT) + 1) AS code FROM events)"""


def _symbols(t):
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n).cast("int"))
    e = t.events.select("event_id", "event_type", "props", pick(_SYMBOLS, 8).alias("name"), pick(("nested_function", "try_catch", "class", "rescue_block"), 4).alias("kind"))
    return e.select("event_id", "name", "kind", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("handles "), F.col("event_type"))).alias("parent"), F.concat("event_type", F.lit(" order user token "), F.col("props"), F.col("name")).alias("code"))


@op("TXT25_purpose", f"WITH {_SYM_SQL} SELECT event_id, {_purpose_sql('name')} AS purpose, array_to_string({_keywords_sql('code')}, ',') AS keywords FROM sym")
def _(t):
    return _symbols(t).select("event_id", md.purpose(F.col("name")).alias("purpose"), F.array_join(md.keywords(F.col("code")), ",").alias("keywords"))


@op("SCL10_inherited_metadata", f"""
WITH {_SYM_SQL} SELECT event_id, CASE WHEN parent = '' THEN {_purpose_sql('name')} WHEN kind = 'nested_function' THEN parent || ' - ' || {_purpose_sql('name')} WHEN kind IN ('try_catch', 'try_except', 'rescue_block') THEN parent || ' - error handling' ELSE parent END AS operation,
  array_to_string(list_concat(['a:0.8', 'b:0.8'], [k || ':0.6' FOR k IN ({_keywords_sql('code')})[1:3]])[1:10], ' ') AS keywords FROM sym""")
def _(t):
    words = md.inherited_keywords(F.array(F.lit("a"), F.lit("b")), F.col("code"))
    flat = F.array_join(F.transform(words, lambda k: F.concat_ws(":", k["keyword"], k["probability"].cast("string"))), " ")
    return _symbols(t).select("event_id", md.inherited_operation(F.col("parent"), F.col("kind"), F.col("name")).alias("operation"), flat.alias("keywords"))


@op("TXT26_all_terms", r"WITH q AS (SELECT list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))[1:2] AS q FROM (SELECT 'The and' AS text)) SELECT doc_id FROM documents WHERE text IS NOT NULL AND list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'and'])")
def _(t):
    return t.documents.where(tx.has_all_terms(F.col("text"), F.lit("The and"))).select("doc_id")


@op("SCL4_timestamps", "SELECT event_id, epoch_us(ts) // 1000 AS millis, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", F.unix_millis(ts).alias("millis"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"))


@op("SCL8_path_structs", "SELECT s_suppkey, 'supplier:' || s_name || ' > nation:' || n_name || ' > region:' || r_name AS chain FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def _(t):
    s = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    step = lambda kind, name: F.struct(F.lit(kind).alias("type"), F.col(name).alias("name"))
    chain = F.array_append(F.array_append(F.array(step("supplier", "s_name")), step("nation", "n_name")), step("region", "r_name"))
    return s.select("s_suppkey", F.array_join(F.transform(chain, lambda x: F.concat_ws(":", x["type"], x["name"])), " > ").alias("chain"))


# --- records ---


@op("REL5_export", "SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS place FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def _(t):
    from pyspark.sql import Window

    rows = t.documents.where("source is not null and lang is not null")
    return rows.select("source", "lang", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("lang", "doc_id")).cast("long").alias("place"))


@op("REL7_instructions", "SELECT s_suppkey, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS company, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS project FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def _(t):
    company = t.region.where("r_regionkey % 2 = 0").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("company"))
    project = t.nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("project"))
    of = t.supplier.join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey", "left")
    return of.join(company, "n_regionkey", "left").join(project, "s_nationkey", "left").select("s_suppkey", "company", "project")


_PUSH_SQL = """
push AS (SELECT event_id, '{"ref":"' || list_extract(['refs/heads/develop', 'refs/heads/main', 'refs/tags/v1', 'refs/heads/refs/heads/x'], CAST(event_id % 4 AS INT) + 1) || '","deleted":' || CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END
  || ',"after":"' || md5(CAST(event_id AS VARCHAR)) || '","repository":{' || CASE WHEN event_id % 7 = 0 THEN '' ELSE '"full_name":"org/' || event_type || '"' END || '},"pusher":{"name":"u' || user_id || '"}}' AS payload FROM events)"""


@op("REL9_push_events", f"""
WITH {_PUSH_SQL}, p AS (SELECT event_id, json_extract_string(payload, '$.ref') AS ref, json_extract_string(payload, '$.repository.full_name') AS repository, json_extract_string(payload, '$.deleted') = 'true' AS deleted, json_extract_string(payload, '$.after') AS sha, json_extract_string(payload, '$.pusher.name') AS pusher FROM push)
SELECT event_id, repository, replace(ref, 'refs/heads/', '') AS branch, pusher, sha, (replace(ref, 'refs/heads/', '') = 'develop' AND NOT deleted) AS process FROM p WHERE starts_with(ref, 'refs/heads/') AND repository <> ''""")
def _(t):
    ref = F.get(F.array(*[F.lit(x) for x in ("refs/heads/develop", "refs/heads/main", "refs/tags/v1", "refs/heads/refs/heads/x")]), (F.col("event_id") % 4).cast("int"))
    repo = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("org/"), F.col("event_type")))
    raw = F.to_json(F.struct(ref.alias("ref"), (F.col("event_id") % 5 == 0).alias("deleted"), F.md5(F.col("event_id").cast("string")).alias("after"), F.struct(repo.alias("full_name")).alias("repository"), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name")).alias("pusher")))
    e = t.events.select("event_id", F.from_json(raw, "ref string, deleted boolean, after string, repository struct<full_name:string>, pusher struct<name:string>").alias("p"))
    branch = F.replace("p.ref", F.lit("refs/heads/"), F.lit(""))
    e = e.where(F.startswith("p.ref", F.lit("refs/heads/")) & (F.col("p.repository.full_name") != ""))
    return e.select("event_id", F.col("p.repository.full_name").alias("repository"), branch.alias("branch"), F.col("p.pusher.name").alias("pusher"), F.col("p.after").alias("sha"), ((branch == "develop") & ~F.coalesce("p.deleted", F.lit(False))).alias("process"))


@op("REL12_agent_context", """
WITH a AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey = 7)
SELECT 'agent' AS kind, s_name AS value FROM a UNION ALL SELECT DISTINCT 'skill', 'p' || l_partkey FROM lineitem JOIN a ON l_suppkey = s_suppkey
UNION ALL SELECT 'peer', s.s_name FROM supplier s JOIN a ON s.s_nationkey = a.s_nationkey AND s.s_suppkey <> a.s_suppkey UNION ALL SELECT 'instructions', n_name FROM nation JOIN a ON n_nationkey = s_nationkey""")
def _(t):
    a = t.supplier.where("s_suppkey = 7")
    row = lambda df, kind, value: df.select(F.lit(kind).alias("kind"), value.alias("value"))
    out = row(a, "agent", F.col("s_name"))
    out = out.unionByName(row(t.lineitem.join(F.broadcast(a.select(F.col("s_suppkey").alias("l_suppkey"))), "l_suppkey").select("l_partkey").distinct(), "skill", _s("p", "l_partkey")))
    out = out.unionByName(row(t.supplier.where("s_suppkey <> 7").join(F.broadcast(a.select("s_nationkey")), "s_nationkey"), "peer", F.col("s_name")))
    return out.unionByName(row(t.nation.join(F.broadcast(a.select(F.col("s_nationkey").alias("n_nationkey"))), "n_nationkey"), "instructions", F.col("n_name")))


# --- results of a model: one an order, its lines as nodes that point at the next line but some ---

_ENTITY_ID = _uuid5("replace(replace(lower({0} || '|' || chunk || '_knowledge'), ' ', '_'), chr(39), '')")


@op("GRB6_extraction_payloads", f"""
WITH n AS (SELECT CAST(l_orderkey AS VARCHAR) AS chunk, l_linenumber AS id, 'Part ' || l_partkey AS name, l_returnflag AS type, CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE l_linestatus END AS description, l_linenumber % 5 + 1 AS target FROM lineitem),
m AS (SELECT chunk, id, max(name) AS name FROM n GROUP BY 1, 2),
e AS (SELECT DISTINCT n.chunk, a.name AS source, b.name AS target, n.type FROM n JOIN m a ON a.chunk = n.chunk AND a.id = n.id JOIN m b ON b.chunk = n.chunk AND b.id = n.target WHERE a.name <> b.name)
SELECT 'entity' AS kind, chunk AS chunk_id, {_ENTITY_ID.replace("{0}", "name")} AS id, NULL AS other, type, CASE WHEN trim(description) = '' THEN name ELSE description END AS said FROM n
UNION ALL SELECT 'edge', chunk, {_ENTITY_ID.replace("{0}", "source")}, {_ENTITY_ID.replace("{0}", "target")}, type, source || '>' || target FROM e""")
def _(t):
    line = F.struct(F.col("l_linenumber").alias("id"), _s("Part ", "l_partkey").alias("name"), F.col("l_returnflag").alias("type"), F.when(F.col("l_suppkey") % 3 == 0, " ").otherwise(F.col("l_linestatus")).alias("description"))
    link = F.struct(F.col("l_linenumber").alias("source"), (F.col("l_linenumber") % 5 + 1).alias("target"), F.col("l_returnflag").alias("type"))
    chunk = F.col("l_orderkey").cast("string")
    results = t.lineitem.groupBy(chunk.alias("chunk_id"), F.concat(chunk, F.lit("_knowledge")).alias("node_set")).agg(F.sort_array(F.collect_list(line)).alias("nodes"), F.collect_list(link).alias("edges"))
    entities, edges = extraction.payloads(results)
    entities = entities.select(F.lit("entity").alias("kind"), "chunk_id", F.col("entity_id").alias("id"), F.lit(None).cast("string").alias("other"), F.col("entity_type").alias("type"), F.col("description").alias("said"))
    return entities.unionByName(edges.select(F.lit("edge").alias("kind"), "chunk_id", F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.col("relationship_type").alias("type"), F.concat("source_name", F.lit(">"), "target_name").alias("said")))
