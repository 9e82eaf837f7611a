"""Rules of intake and search by their exact values, and keyed writes and checks on rows that exist."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expansion, filerules
from ..functions import text as tx
from ..operators import upserts
from .base import op

# --- files ---

#: What a page's path goes on with, by page_id: names that meet each rule, and some that only look like it.
_ENDINGS = (".py", "/LICENSE", "/License.rst", ".min.js", "/.git/x.py", "/node_modules/a.js", "/Env/b.py", "/env/b.py", "/x.egg-info/c.py", "/Dockerfile", "/a.", "/docker-compose.dev.py", ".PNG", "/.env.py", "/licenses.py", "/src//./main.rs", "", "/build/.rb", "/readme.py/ok.go")


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_PATHS_SQL = f"SELECT page_id, regexp_extract(coalesce(url, ''), '://[^/]*/([^?#]*)', 1) || {_sql_list(_ENDINGS)}[page_id % {len(_ENDINGS)} + 1] AS path, strlen(coalesce(html, '')) * (page_id % 997) AS size FROM pages"
_VERDICTS_SQL = f"""
f AS ({_PATHS_SQL}),
p AS (SELECT *, [x FOR x IN string_split(path, '/') IF x NOT IN ('', '.')] AS parts FROM f),
n AS (SELECT *, lower(coalesce(parts[-1], '')) AS name, regexp_extract(lower(coalesce(parts[-1], '')), '^.+(\\.[^.]+)$', 1) AS suffix FROM p),
names AS (SELECT unnest({_sql_list(filerules.REJECTED_FILENAMES)}) AS pattern, generate_subscripts({_sql_list(filerules.REJECTED_FILENAMES)}, 1) AS nr),
folders AS (SELECT unnest({_sql_list(filerules.REJECTED_DIRECTORIES)}) AS pattern, generate_subscripts({_sql_list(filerules.REJECTED_DIRECTORIES)}, 1) AS nr),
by_name AS (SELECT page_id, arg_min(pattern, nr) AS pattern FROM n, names WHERE name GLOB lower(pattern) GROUP BY 1),
each AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM n),
by_part AS (SELECT page_id, arg_min(pattern, (nr, i)) AS pattern, arg_min(part, (nr, i)) AS part FROM each, folders WHERE part GLOB pattern GROUP BY 1),
v AS (SELECT n.page_id, CASE WHEN size > {filerules.MAX_FILE_SIZE} THEN ['size', 'File size ' || size || ' exceeds limit {filerules.MAX_FILE_SIZE}']
  WHEN b.pattern IS NOT NULL THEN ['extension', 'Filename ''' || name || ''' matches rejected pattern ''' || b.pattern || '''']
  WHEN suffix = '' THEN ['extension', 'File ''' || name || ''' has no extension']
  WHEN suffix IN (SELECT unnest({_sql_list(filerules.REJECTED_EXTENSIONS)})) THEN ['extension', 'Extension ' || suffix || ' is rejected']
  WHEN d.pattern IS NOT NULL THEN ['directory', 'Directory ''' || d.part || ''' matches rejected pattern ''' || d.pattern || ''''] ELSE ['none', ''] END AS v
  FROM n LEFT JOIN by_name b ON b.page_id = n.page_id LEFT JOIN by_part d ON d.page_id = n.page_id)"""


def _verdicts(t):
    ending = F.get(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("page_id") % len(_ENDINGS)).cast("int"))
    path = F.concat(F.regexp_extract(F.coalesce("url", F.lit("")), "://[^/]*/([^?#]*)", 1), ending)
    size = F.octet_length(F.coalesce("html", F.lit(""))) * (F.col("page_id") % 997)
    return t.pages.select("page_id", filerules.verdict(path, size).alias("v")).select("page_id", "v.reason", "v.detail")


@op("FLT11_ingestion_rules", f"WITH {_VERDICTS_SQL} SELECT page_id, v[1] AS reason, v[2] AS detail FROM v")
def _(t):
    return _verdicts(t)


@op("FLT12_ingestion_stats", f"WITH {_VERDICTS_SQL} SELECT v[1] AS reason, count(*) AS n FROM v GROUP BY 1")
def _(t):
    return _verdicts(t).groupBy("reason").agg(F.count("*").alias("n"))


# --- scopes and queries ---


@op("FLT22_scope_strings", r"""
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN source END AS company, CASE doc_id % 9 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'code:' || source || ':' || lang WHEN 2 THEN 'code:' || source WHEN 3 THEN 'code::' || lang WHEN 4 THEN 'code:' || source || ':' WHEN 5 THEN 'code:' || source || ':a:' || lang WHEN 6 THEN 'Knowledge' WHEN 7 THEN '' END AS scope FROM documents)
SELECT doc_id, CASE WHEN scope = 'knowledge' AND company <> '' THEN company || '_knowledge' WHEN starts_with(scope, 'code:') AND len(string_split(scope, ':')) >= 3 AND string_split(scope, ':')[2] <> '' AND array_to_string(string_split(scope, ':')[3:], ':') <> '' THEN string_split(scope, ':')[2] || '_' || array_to_string(string_split(scope, ':')[3:], ':') || '_code' END AS scope_key FROM s""")
def _(t):
    n = F.col("doc_id") % 9
    code = lambda *rest: F.concat(F.lit("code:"), *[F.lit(r) if r in (":", ":a:") else F.col(r) for r in rest])
    scope = F.when(n == 0, "knowledge").when(n == 1, code("source", ":", "lang")).when(n == 2, code("source")).when(n == 3, code(":", "lang")).when(n == 4, code("source", ":")).when(n == 5, code("source", ":a:", "lang")).when(n == 6, "Knowledge").when(n == 7, "")
    company = F.when(F.col("doc_id") % 4 != 1, F.col("source"))
    return t.documents.select("doc_id", tx.scope_key(company, scope).alias("scope_key"))


_QUERY_VERBS = (*expansion.VERBS, "show")
_SP = r"[\s\x0B]"
_OBJECT_SQL = [(v, rf"trim(regexp_replace(regexp_extract(q, '(?:^|[^\p{{L}}\p{{N}}_]){v}(?:{_SP}+(?:a|an|the))?{_SP}+(.+?)(?:{_SP}+(?:{'|'.join(expansion.PREPOSITIONS)})(?:[^\p{{L}}\p{{N}}_]|$)|$)', 1), '^(?:a|an|the){_SP}+', ''))") for v in expansion.VERBS]


def _pascal_sql(x: str) -> str:
    return f"array_to_string([upper(w[1:1]) || w[2:] FOR w IN regexp_extract_all({x}, '[A-Za-z0-9]+') IF lower(w) NOT IN ({', '.join(repr(w) for w in tx.EXPANSION_STOP_WORDS)})], '')"


@op("FUS8_query_variants", f"""
WITH b AS (SELECT item_id, trim('  Please ' || {_sql_list(_QUERY_VERBS)}[item_id % {len(_QUERY_VERBS)} + 1] || CASE WHEN item_id % 2 = 0 THEN ' the ' ELSE ' ' END || coalesce(text, ''), E' \\n\\t') AS original FROM benchmark),
o AS (SELECT item_id, original, lower(original) AS q FROM b),
t AS ({' UNION ALL '.join(f"SELECT item_id, {i} AS nr, '{v}' AS verb, {sql} AS obj FROM o" for i, (v, sql) in enumerate(_OBJECT_SQL))}),
f AS (SELECT item_id, arg_min(verb, nr) AS verb, arg_min(obj, nr) AS obj FROM t WHERE {_pascal_sql('obj')} <> '' GROUP BY 1),
c AS (SELECT o.item_id, 1 AS nr, original AS variant FROM o
  UNION ALL SELECT item_id, 2, 'use' || upper(verb[1:1]) || verb[2:] || {_pascal_sql('obj')} || ' hook' FROM f
  UNION ALL SELECT item_id, 3, verb || ' ' || obj || ' endpoint' FROM f
  UNION ALL SELECT item_id, 4, original || '?' FROM o WHERE item_id % 3 > 0
  UNION ALL SELECT item_id, 5, q FROM o WHERE item_id % 3 > 0),
d AS (SELECT item_id, variant, min(nr) AS nr FROM c GROUP BY 1, 2), r AS (SELECT item_id, variant, row_number() OVER (PARTITION BY item_id ORDER BY nr) AS place FROM d)
SELECT item_id, place, variant FROM r WHERE place <= 4""")
def _(t):
    verb = F.get(F.array(*[F.lit(v) for v in _QUERY_VERBS]), (F.col("item_id") % len(_QUERY_VERBS)).cast("int"))
    query = F.concat(F.lit("  Please "), verb, F.when(F.col("item_id") % 2 == 0, F.lit(" the ")).otherwise(F.lit(" ")), F.coalesce("text", F.lit("")))
    original = F.regexp_replace(query, r"(?U)^\s+|\s+$", "")
    said = F.when(F.col("item_id") % 3 > 0, F.array(original, F.concat(original, F.lit("?")), F.lit(" "), F.lower(original)))  # what a model answered; null where it failed
    out = t.benchmark.select("item_id", F.posexplode(expansion.variants(query, said)).alias("place", "variant"))
    return out.select("item_id", (F.col("place") + 1).cast("long").alias("place"), "variant")


# --- writes and checks on rows that exist ---


@op("SNK8_replaced_chunks", """
WITH n AS (SELECT 'c' || user_id AS chunk_id, max(event_id) AS seq, max_by(event_type, event_id) AS content FROM events WHERE user_id IS NOT NULL GROUP BY 1)
SELECT * FROM n UNION ALL SELECT 'c' || doc_id, CAST(-1 AS BIGINT), source FROM documents WHERE 'c' || doc_id NOT IN (SELECT chunk_id FROM n)""")
def _(t):
    target = t.documents.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.lit(-1).cast("long").alias("seq"), F.col("source").alias("content"))
    staged = t.events.where("user_id is not null").select(F.concat(F.lit("c"), "user_id").alias("chunk_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"))
    return upserts.upsert(target, staged, ["chunk_id"], ["seq"])


@op("JN19_orphan_entities", """
SELECT l_partkey || '|' || l_suppkey AS entity, count(*) AS chunks FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey, l_suppkey HAVING bool_and(coalesce(o_orderstatus = 'F', true))""")
def _(t):
    mentions = t.lineitem.select(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("entity"), F.col("l_orderkey").alias("chunk"))
    return upserts.orphans(mentions, t.orders.where("o_orderstatus is null or o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("chunk")))


@op("JN20_integrity_checks", """
WITH e AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id IS NOT NULL)
SELECT 'orphan_entity' AS finding, id FROM e WHERE id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'untyped_entity', id FROM e WHERE id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)
UNION ALL SELECT DISTINCT 'empty_chunk', doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT id FROM e)""")
def _(t):
    mentions = t.events.select(F.col("user_id").alias("entity"), F.col("user_id").alias("chunk"))
    chunks = t.documents.select(F.col("doc_id").alias("chunk"))
    typed = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("entity"))
    return upserts.integrity(mentions, chunks, typed)
