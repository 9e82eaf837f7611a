"""Text, scalar and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, filetree
from .base import op

_CAMEL = r"regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"


@op("TXT1_camel_split", f"SELECT p_partkey, {_CAMEL.format('p_type')} AS name FROM part")
def _(t):
    return t.part.select("p_partkey", tx.camel_split(F.col("p_type")).alias("name"))


@op("TXT4_reject_key", r"SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(p_brand || '_' || p_type, '[_-]', ' ', 'g')), '\s+', ' ', 'g')) AS key FROM part")
def _(t):
    return t.part.select("p_partkey", tx.reject_key(F.concat_ws("_", "p_brand", "p_type")).alias("key"))


@op("TXT5_domain_key")
def _(t):
    return t.part.select("p_partkey", tx.domain_key(F.concat_ws(" ", "p_name", "p_type")).alias("key"))


@op("TXT6_organisation", r"SELECT c_custkey, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(c_name || ' (x) Corp. Inc'), '\([^)]*\)', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), '(\s+(corporation|corp|inc|incorporated|llc|ltd|limited|company|co|gmbh|plc))+$', '')) AS name FROM customer")
def _(t):
    return t.customer.select("c_custkey", tx.organisation_name(F.concat("c_name", F.lit(" (x) Corp. Inc"))).alias("name"))


@op("TXT7_trailing_suffix", r"SELECT p_partkey, regexp_extract(lower(p_name || ' ' || p_size), '\s(go|pro|lite|plus|enterprise|premium|basic|standard|express|[0-9]+(?:/[0-9]+)?)$', 1) AS suffix FROM part")
def _(t):
    return t.part.select("p_partkey", tx.trailing_suffix(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("suffix"))


@op("TXT9_description_overlap")
def _(t):
    b = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return t.benchmark.join(b, "item_id").select("item_id", F.round(tx.description_overlap(F.col("text"), F.col("other")), 6).alias("overlap"))


@op("TXT10_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def _(t):
    a, b = (t.nation.select("n_regionkey", F.col("n_name").alias(x)) for x in "ab")
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"))


@op("TXT17_canonical_path", "SELECT page_id, lower(replace(url, '\\', '/')) AS path FROM pages")
def _(t):
    return t.pages.select("page_id", F.lower(F.replace("url", F.lit("\\"), F.lit("/"))).alias("path"))


@op("TXT19_triplet_text", "SELECT n_name || '-›' || 'in_region' || '-›' || r_name AS text FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(t):
    return t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(tx.triplet_text(F.col("n_name"), F.lit("in_region"), F.col("r_name")).alias("text"))


@op("TXT20_mime", "SELECT page_id, CASE WHEN suffix(lower(url), '.html') THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM pages")
def _(t):
    return t.pages.select("page_id", tx.mime_type(F.lower("url"), "application/octet-stream").alias("mime"))


_MIME = " ".join(f"WHEN suffix(url, '{suffix}') THEN '{kind}'" for suffix, kind in tx.MIME_BY_SUFFIX)


@op("TXT20_mime_all", f"SELECT page_id, CASE {_MIME} ELSE 'text/plain' END AS mime, {tx.by_extension_sql('url', tx.CONTEXT_MIME_BY_EXTENSION, default='text/plain')} AS context_mime FROM pages")
def _(t):
    return t.pages.select("page_id", tx.mime_type(F.col("url")).alias("mime"), tx.context_mime(F.col("url")).alias("context_mime"))


@op("TXT22_slugify", r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_brand || ' 2.0 ' || p_type)), '[^a-z0-9_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", tx.slugify(F.concat(F.col("p_brand"), F.lit(" 2.0 "), F.col("p_type"))).alias("slug"))


@op("TXT23_line_range", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS code FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(F.slice(F.split("text", "\n", -1), 2, 3), "\n").alias("code"))


@op("TXT24_sanitize", r"SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.sanitized(F.col("text")).alias("text"))


@op("TXT24_stored_text", r"SELECT doc_id, nfc_normalize(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.stored_text(F.col("text")).alias("text"))


@op("TXT27_chunk_header", "SELECT doc_id, 'PROJECT: ' || source || chr(10) || chr(10) || 'FILE: ' || doc_id || chr(10) || chr(10) || 'CODE (1/1)' AS header FROM documents")
def _(t):
    return t.documents.select("doc_id", F.concat_ws("\n\n", F.concat(F.lit("PROJECT: "), F.col("source")), F.concat(F.lit("FILE: "), F.col("doc_id").cast("string")), F.lit("CODE (1/1)")).alias("header"))


@op("SCL5_json_metadata", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@op("SCL6_json_contains", "SELECT event_id FROM events WHERE contains(props, '\"k\": 7')")
def _(t):
    return t.events.where(F.col("props").contains('"k": 7')).select("event_id")


@op("SCL7_left_defaults", "SELECT doc_id, left(text, 200) AS text, coalesce(lang, 'unknown') AS lang FROM documents")
def _(t):
    return t.documents.select("doc_id", F.left("text", F.lit(200)).alias("text"), F.coalesce("lang", F.lit("unknown")).alias("lang"))


@op("SCL9_base64", "SELECT item_id, 'base64:' || base64(encode(text)) AS encoded FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.concat(F.lit("base64:"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "\r?\n", "")).alias("encoded"))


@op("SCL11_repair_defaults", "SELECT p_partkey, CASE WHEN trim(coalesce(nullif(p_type, 'BRASS'), '')) = '' THEN p_name ELSE p_type END AS description FROM part")
def _(t):
    d = F.coalesce(F.nullif("p_type", F.lit("BRASS")), F.lit(""))
    return t.part.select("p_partkey", F.when(F.trim(d) == "", F.col("p_name")).otherwise(F.col("p_type")).alias("description"))


@op("SCL12_size_label", "SELECT doc_id, CASE WHEN n_chars < 100 THEN 'S' WHEN n_chars < 500 THEN 'M' ELSE 'L' END AS label FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.size_label(F.col("n_chars")).alias("label"))


@op("SCL13_enum", "SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('click', 'view') THEN lower(trim(event_type)) END AS kind FROM events")
def _(t):
    e = F.lower(F.trim("event_type"))
    return t.events.select("event_id", F.when(e.isin("click", "view"), e).alias("kind"))


@op("CHK1_document_chunks")
def _(t):
    return chunking.chunk_documents(t.documents, "doc_id", "text")


@op("CHK5_line_windows", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), s AS (SELECT doc_id, x, unnest(generate_series(0, greatest(len(x) - 2 - 1, 0), 3)) AS pos FROM l) SELECT doc_id, pos // 3 AS chunk_index, pos + 1 AS start_line, least(pos + 5, len(x)) AS end_line, array_to_string(x[pos + 1:pos + 5], chr(10)) AS chunk FROM s")
def _(t):
    c = chunking.line_windows(t.documents.select("doc_id", "text"), "text", 5, 2)
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "chunk")


@op("CHK7_token_windows", r"WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '\s+') IF x <> ''] AS t FROM documents) SELECT doc_id, unnest(range(0, len(t), 512)) // 512 AS chunk_index, len(t) AS tokens FROM w WHERE len(t) > 0")
def _(t):
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    return chunking.token_windows(t.documents.select("doc_id", "text", n.alias("tokens")), "text").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "tokens")


@op("CHK11_explode_events", "SELECT conv_id, turn, unnest(string_split(text, ' ')) AS item FROM conversations WHERE role = 'system'")
def _(t):
    return t.conversations.where("role = 'system'").select("conv_id", "turn", F.explode(F.split("text", " ", -1)).alias("item"))


@op("CHK2_text_chunks")
def _(t):
    return chunking.chunk_texts(t.documents, "doc_id", "text")


@op("CHK6_line_chunks")
def _(t):
    return chunking.chunk_lines(t.documents, "doc_id", "text")


_NESTED_SQL = "[struct_pack(kind := 'nested_function', name := 'n' || i, start_line := i * 20, end_line := i * 20 + CAST(doc_id % 15 AS BIGINT)) FOR i IN range(1, CAST(doc_id % 4 AS BIGINT) + 1)]"


@op("CHK8_method_chunks", f"""
WITH m AS (SELECT 'd' || doc_id AS document_id, 'm' || doc_id AS name, 1 AS start_line, 100 AS end_line, length(coalesce(text, '')) AS size, 'd' || doc_id || ':method:m' || doc_id || ':1' AS own, {_NESTED_SQL} AS nested FROM documents),
n AS (SELECT own, unnest(nested) AS n FROM m WHERE size >= 2000)
SELECT own AS chunk_id, NULL AS parent_id, 'method' AS kind, name, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM m
UNION ALL SELECT own || ':nested:' || n.kind || ':' || n.name || ':' || n.start_line, own, n.kind, n.name, n.start_line, n.end_line FROM n WHERE n.end_line - n.start_line + 1 >= 10""")
def _(t):
    i = F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))
    nested = F.transform(F.filter(i, lambda k: k <= F.col("doc_id") % 4), lambda k: F.struct(F.lit("nested_function").alias("kind"), F.concat(F.lit("n"), k.cast("string")).alias("name"), (k * 20).alias("start_line"), (k * 20 + F.col("doc_id") % 15).alias("end_line")))
    s = lambda prefix: F.concat(F.lit(prefix), F.col("doc_id").cast("string"))
    m = t.documents.select(s("d").alias("document_id"), s("m").alias("name"), F.lit(1).cast("long").alias("start_line"), F.lit(100).cast("long").alias("end_line"), F.coalesce("text", F.lit("")).alias("code"), nested.alias("nested"))
    return chunking.method_chunks(m)


@op("CHK10_file_tree")
def _(t):
    number = lambda n: (F.col("doc_id") % n).cast("string")
    path = F.concat(F.lit("app/api/"), F.coalesce("source", F.lit("none")), F.lit("/v"), number(3), F.lit("/f"), number(40), F.lit(".py"))
    files = t.documents.groupBy(path.alias("path")).agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("lines"))
    return filetree.tree_lines(files).select(F.array_join("key", "/").alias("key"), "line")
