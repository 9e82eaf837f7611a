"""Canonical names, fuzzy merges and the guard of read-only queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import canonical as cn
from ..functions import guard
from ..operators import clusters
from .base import op

# entities of the tables: parts, by name with endings that tell products, companies and tiers apart
_ENDINGS = ("", " Inc", " Pro", " 2", " (beta)", " platform")
_ENTITIES_SQL = f"""
ent AS (SELECT p_partkey AS id, p_type AS entity_type, p_name || list_extract({list(_ENDINGS)!r}, CAST(p_size % 6 AS INT) + 1) AS name, p_type || ' with ' || p_name AS description FROM part)"""


def _entities(t):
    ending = F.get(F.array(*[F.lit(x) for x in _ENDINGS]), (F.col("p_size") % 6).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("entity_type"), F.concat("p_name", ending).alias("name"), F.concat("p_type", F.lit(" with "), F.col("p_name")).alias("description"))


def _next(t):
    """Each entity beside the one of the next id."""
    e = _entities(t)
    return e.join(e.select((F.col("id") - 1).alias("id"), F.col("name").alias("other"), F.col("description").alias("other_description")), "id")


_NEXT_SQL = _ENTITIES_SQL + ", pair AS (SELECT e.*, o.name AS other, o.description AS other_description FROM ent e JOIN ent o ON o.id = e.id + 1)"


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _hints(x: str) -> str:
    return rf"regexp_replace(lower({x}), '\([^)]*\)', ' ', 'g')"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(array_to_string(regexp_extract_all({_hints(x)}, '[a-z0-9]+'), ' '), '(?:(?:^| )(?:{'|'.join(cn.NOISE_SUFFIXES)}))+$', ''))"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace({_hints(x)}, '\s+', ' ', 'g'))"


def _suffix(x: str) -> str:
    return f"nullif(regexp_extract({_clean(x)}, '{cn.TRAILING}', 1), '')"


def _stem(x: str) -> str:
    return rf"CASE WHEN {_suffix(x)} IS NULL THEN {_clean(x)} ELSE trim(regexp_replace(regexp_replace({_clean(x)}, '{cn.TRAILING}', ''), '[\s:;,.\-_/]+$', '')) END"


def _described(x: str) -> str:
    return f"list_distinct([w FOR w IN {_tokens(x)} IF length(w) > 1 AND w NOT IN {_list(cn.DESCRIPTION_STOP_WORDS)}])"


def _overlap(a: str, b: str) -> str:
    x, y = _described(a), _described(b)
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN CAST(len(list_intersect({x}, {y})) AS DOUBLE) / least(len({x}), len({y})) ELSE 0.0 END"


def _noise(w: str) -> str:
    return f"({w} IN {_list(cn.NOISE_TOKENS)} OR regexp_matches({w}, '^(?:[0-9]+|[a-z]{{1,4}})$'))"


def _contained(x: str, y: str, dx: str, dy: str) -> str:
    extra = f"[w FOR w IN string_split({y}, ' ') IF NOT list_contains(string_split({x}, ' '), w)]"
    only_noise = f"(len({extra}) > 0 AND len([w FOR w IN {extra} IF NOT {_noise('w')}]) = 0)"
    return f"({x} <> '' AND {y} <> '' AND contains({y}, {x}) AND ({x} = {y} OR {only_noise} OR {_overlap(dx, dy)} >= 0.6))"


def _reason(x: str, y: str, dx: str, dy: str) -> str:
    return f"CASE WHEN {x} = {y} THEN 'exact_normalised' WHEN {x} = '' OR {y} = '' THEN NULL WHEN {_contained(x, y, dx, dy)} OR {_contained(y, x, dy, dx)} THEN 'substring_or_description_overlap' WHEN levenshtein({x}, {y}) <= 2 THEN 'levenshtein' END"


def _blocked(a: str, b: str) -> str:
    return f"CASE WHEN {_suffix(a)} IS NULL AND {_suffix(b)} IS NULL THEN false WHEN {_suffix(a)} IS NOT NULL AND {_suffix(b)} IS NOT NULL THEN {_stem(a)} = {_stem(b)} AND {_suffix(a)} <> {_suffix(b)} WHEN {_suffix(a)} IS NOT NULL THEN {_stem(a)} = {_norm(b)} ELSE {_stem(b)} = {_norm(a)} END"


def _score(x: str) -> str:
    own = _tokens(_norm(x))
    return f"""struct_pack(tokens := CAST(len({own}) AS INT), length := CAST(length({_norm(x)}) AS INT), hint := CASE WHEN contains({x}, '(') AND contains({x}, ')') THEN -1 ELSE 0 END,
  vendor := CASE WHEN len({own}) > 1 AND list_extract({own}, 1) NOT IN {_list(cn.NOISE_TOKENS)} THEN 1 ELSE 0 END,
  short := -CAST(len([w FOR w IN regexp_extract_all({x}, '[A-Za-z0-9]+') IF regexp_matches(w, '^[A-Z]{{1,4}}$')]) AS INT), name := lower(trim({x})))"""


@op("TXT6_normalised_name", f"WITH {_ENTITIES_SQL} SELECT id, {_norm('name')} AS norm FROM ent")
def _(t):
    return _entities(t).select("id", cn.normalised(F.col("name")).alias("norm"))


@op("TXT7_suffix_split", f"WITH {_ENTITIES_SQL} SELECT id, {_stem('name')} AS stem, {_suffix('name')} AS suffix FROM ent")
def _(t):
    return _entities(t).select("id", cn.suffix_split(F.col("name")).alias("s")).select("id", "s.stem", "s.suffix")


@op("TXT8_merge_block", f"WITH {_NEXT_SQL} SELECT id, {_blocked('name', 'other')} AS blocked FROM pair")
def _(t):
    return _next(t).select("id", cn.merge_blocked(F.col("name"), F.col("other")).alias("blocked"))


@op("TXT9_overlap", f"WITH {_NEXT_SQL} SELECT id, round({_overlap('description', 'other_description')}, 6) AS overlap FROM pair")
def _(t):
    return _next(t).select("id", F.round(cn.overlap(F.col("description"), F.col("other_description")), 6).alias("overlap"))


@op("TXT11_noise_token", f"WITH {_ENTITIES_SQL}, w AS (SELECT id, unnest({_tokens('name')}) AS token FROM ent) SELECT id, token, {_noise('token')} AS noise FROM w")
def _(t):
    return _entities(t).select("id", F.explode(cn.tokens(F.col("name"))).alias("token")).select("id", "token", cn.noise_token(F.col("token")).alias("noise"))


@op("TXT12_substring_rule", f"WITH {_NEXT_SQL}, n AS (SELECT *, {_norm('name')} AS x, {_norm('other')} AS y FROM pair) SELECT id, {_contained('x', 'y', 'description', 'other_description')} AS contained FROM n")
def _(t):
    return _next(t).select("id", cn.contained(cn.normalised(F.col("name")), cn.normalised(F.col("other")), F.col("description"), F.col("other_description")).alias("contained"))


@op("TXT13_match_reason", f"WITH {_NEXT_SQL}, n AS (SELECT *, {_norm('name')} AS x, {_norm('other')} AS y FROM pair) SELECT id, {_reason('x', 'y', 'description', 'other_description')} AS reason FROM n")
def _(t):
    none = F.array().cast("array<string>").alias("aliases")
    a, b = F.struct("name", "description", none), F.struct(F.col("other").alias("name"), F.col("other_description").alias("description"), none)
    return _next(t).select("id", cn.match_reason(a, b).alias("reason"))


@op("TXT14_canonical_score", f"WITH {_ENTITIES_SQL} SELECT entity_type, name FROM (SELECT entity_type, name, row_number() OVER (PARTITION BY entity_type ORDER BY {_score('name')} DESC, name) AS nr FROM ent) WHERE nr = 1")
def _(t):
    best = _entities(t).groupBy("entity_type").agg(F.max(F.struct(cn.canonical_score(F.col("name")).alias("score"), F.col("name"))).alias("best"))
    return best.select("entity_type", "best.name")


_PAIRS_SQL = f"""{_ENTITIES_SQL},
c AS (SELECT entity_type, name, min(description) AS description, {_norm('name')} AS norm FROM ent GROUP BY entity_type, name),
fuzzy AS (SELECT * FROM (SELECT x.entity_type, x.name AS a, y.name AS b, {_reason('x.norm', 'y.norm', 'x.description', 'y.description')} AS reason
  FROM c x JOIN c y ON x.entity_type = y.entity_type AND x.name < y.name) WHERE reason IS NOT NULL)"""
_CLUSTERS_SQL = f"""{_PAIRS_SQL},
e AS MATERIALIZED (SELECT entity_type, a, b FROM fuzzy UNION ALL SELECT entity_type, b, a FROM fuzzy),
reach AS (SELECT entity_type, name, name AS other FROM c UNION SELECT r.entity_type, r.name, e.b FROM reach r JOIN e ON e.entity_type = r.entity_type AND e.a = r.other),
clu AS (SELECT entity_type, name, min(other) AS cluster FROM reach GROUP BY 1, 2)"""


@op("JN25_fuzzy_pairs", f"WITH {_PAIRS_SQL} SELECT entity_type, a, b, reason FROM fuzzy")
def _(t):
    return clusters.fuzzy_pairs(_entities(t))


@op("TXT18_clusters", f"WITH RECURSIVE {_CLUSTERS_SQL} SELECT entity_type, name, cluster FROM clu")
def _(t):
    return clusters.clusters(_entities(t))


_MERGES_SQL = f"""{_CLUSTERS_SQL},
best AS (SELECT entity_type, name, first_value(name) OVER (PARTITION BY entity_type, cluster ORDER BY {_score('name')} DESC, name) AS canonical FROM clu),
mer AS (SELECT entity_type, name AS duplicate, canonical FROM best WHERE name <> canonical AND NOT coalesce({_blocked('canonical', 'name')}, false))"""


@op("GRB5_entity_merge", f"WITH RECURSIVE {_MERGES_SQL} SELECT ent.id, coalesce(canonical, name) AS canonical FROM ent LEFT JOIN mer ON mer.entity_type = ent.entity_type AND mer.duplicate = ent.name")
def _(t):
    e = _entities(t)
    gone = clusters.merges(e).withColumnRenamed("duplicate", "name")
    return e.join(gone, ["entity_type", "name"], "left").select("id", F.coalesce("canonical", "name").alias("canonical"))


# tags as a model gives them: domains, tools and a technical type, some odd
_TYPES = ("BusinessDomain", "TechnicalTag", "Tool", "Organization", "Class")
_TAGS_SQL = f"""
tag AS (SELECT p_partkey AS id, list_extract({list(_TYPES)!r}, CAST(p_size % 5 AS INT) + 1) AS entity_type,
  CASE p_partkey % 11 WHEN 0 THEN 'emergency_care' WHEN 1 THEN ' ' WHEN 2 THEN 'BusinessDomain' WHEN 3 THEN 'aiIntegration' WHEN 4 THEN upper(p_name) WHEN 5 THEN 'HTTPSConnection' WHEN 6 THEN p_name || '.sales' WHEN 7 THEN NULL ELSE p_name END AS name FROM part)"""
_SPLIT = r"regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
_ACRONYMS = "('ai', 'api', 'soap', 'prro', 'http', 'https', 'sql', 'url', 'ui', 'sdk', 'cli', 'rest', 'json', 'xml', 'css', 'html', 'js', 'ts', 'db')"


def _title(x: str) -> str:
    words = rf"string_split(trim(regexp_replace({_SPLIT.format(f'''replace({x}, '_', ' ')''')}, '\s+', ' ', 'g')), ' ')"
    return f"array_to_string([CASE WHEN lower(w) IN {_ACRONYMS} THEN upper(w) ELSE upper(w[1:1]) || lower(w[2:]) END FOR w IN {words}], ' ')"


_REJECT = rf"trim(regexp_replace(lower(regexp_replace(trim(coalesce(name, '')), '[_-]', ' ', 'g')), '\s+', ' ', 'g')) IN {_list(cn.REJECTED_DOMAINS)}"
_KEY = r"lower(trim(regexp_replace(" + _SPLIT.format(r"regexp_replace(regexp_replace({0}, '[().\[\]{{}}&+,;:!?\"'']', ' ', 'g'), '[_-]', ' ', 'g')") + r", '\s+', ' ', 'g')))"
_CANON_SQL = f"""{_TAGS_SQL},
kept AS (SELECT id, entity_type, CASE WHEN entity_type IN {_list(cn.BUSINESS_TAG_TYPES)} THEN {_title('trim(name)')} ELSE name END AS name FROM tag
  WHERE NOT (entity_type IN {_list(cn.BUSINESS_TAG_TYPES)} AND (trim(coalesce(name, '')) = '' OR trim(name) = entity_type OR (entity_type = 'BusinessDomain' AND {_REJECT}))))"""


def _tags(t):
    p = F.col("p_partkey") % 11
    name = F.when(p == 0, "emergency_care").when(p == 1, " ").when(p == 2, "BusinessDomain").when(p == 3, "aiIntegration").when(p == 4, F.upper("p_name")).when(p == 5, "HTTPSConnection").when(p == 6, F.concat("p_name", F.lit(".sales"))).when(p == 7, None).otherwise(F.col("p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), F.get(F.array(*[F.lit(x) for x in _TYPES]), (F.col("p_size") % 5).cast("int")).alias("entity_type"), name.alias("name"))


@op("TXT1_canonical_name", f"WITH {_TAGS_SQL} SELECT id, {_title('name')} AS name FROM tag")
def _(t):
    return _tags(t).select("id", cn.canonical_name(F.col("name")).alias("name"))


@op("TXT2_canonicalise", f"WITH {_CANON_SQL} SELECT id, entity_type, name FROM kept")
def _(t):
    return cn.canonicalised(_tags(t))


@op("TXT3_whitelist", f"""
WITH {_CANON_SQL}, first AS (SELECT split_part(p_name, ' ', 1) AS canonical, min(p_partkey) AS place FROM part GROUP BY 1), wl AS (SELECT {_KEY.format('canonical')} AS key, place, canonical FROM first),
d AS (SELECT *, {_KEY.format('name')} AS own FROM kept WHERE entity_type = 'BusinessDomain'),
m AS (SELECT d.id, entity_type, arg_min(canonical, struct_pack(partly := own <> key, place := place)) AS name FROM d JOIN wl ON own = key OR starts_with(own, key || ' ') GROUP BY 1, 2)
SELECT id, entity_type, name FROM m UNION ALL SELECT id, entity_type, name FROM kept WHERE entity_type <> 'BusinessDomain'""")
def _(t):
    first = t.part.groupBy(F.substring_index("p_name", " ", 1).alias("canonical_name")).agg(F.min("p_partkey").alias("place"))
    return cn.canonicalised(_tags(t), cn.whitelist(first, "place"))


# --- the guard of read-only graph queries ---
_FORMS = (
    "MATCH (n:Part) RETURN n LIMIT {}",
    "MATCH (n) RETURN n.calls",
    "match (n) detach  delete n",
    "  // a comment\n MATCH (n)-[:calls]->(m) RETURN m limit {}",
    "OPTIONAL MATCH (n) RETURN n",
    "LOAD  CSV FROM 'x' AS l RETURN l",
    "EXPLAIN MATCH (n) RETURN n",
    "",
)


def _cypher(t):
    form = F.get(F.array(*[F.lit(x) for x in _FORMS]), F.pmod("event_id", F.lit(len(_FORMS))).cast("int"))
    text = F.replace(form, F.lit("{}"), (F.col("event_id") * 7 % 1500).cast("string"))
    return t.events.select("event_id", F.when(F.col("event_id") % 101 == 0, F.rpad(text, 6000, "x")).otherwise(text).alias("q"))


_QUOTED = ", ".join("'" + x.replace("'", "''") + "'" for x in _FORMS)
_CYPHER_SQL = f"""
f AS (SELECT event_id, replace(list_extract([{_QUOTED}], CAST(event_id % {len(_FORMS)} AS INT) + 1), '{{}}', CAST(event_id * 7 % 1500 AS VARCHAR)) AS text FROM events),
q AS (SELECT event_id, CASE WHEN event_id % 101 = 0 THEN rpad(text, 6000, 'x') ELSE text END AS q FROM f)"""


def _verbs_sql() -> str:
    whens = " ".join(rf"WHEN regexp_matches(upper(q), '{p}') THEN 'Forbidden command: ' || regexp_extract(upper(q), '{p}', 0) || '. Only read-only queries allowed (MATCH, RETURN, WHERE, WITH, etc.)'" for p in guard.FORBIDDEN)
    return whens


@op("FLT18_query_guard", rf"""
WITH {_CYPHER_SQL}, s AS (SELECT *, regexp_extract(regexp_replace(q, '(?m)^\s*(//.*\n\s*)*', '', 'g'), '^\s*(\S+)', 1) AS word, regexp_extract(upper(q), 'LIMIT\s+(\d+)', 1) AS lim FROM q),
r AS (SELECT event_id, CASE WHEN length(q) > 5000 THEN 'Query too long (' || length(q) || ' chars). Maximum: 5000 chars' {_verbs_sql()} WHEN word = '' THEN 'Empty query'
  WHEN upper(word) NOT IN ('MATCH', 'RETURN', 'WITH', 'UNWIND') THEN 'Query must start with MATCH, RETURN, WITH, OPTIONAL MATCH, UNWIND. Got: ' || upper(word)
  WHEN lim <> '' AND CAST(lim AS HUGEINT) > 1000 THEN 'LIMIT ' || CAST(lim AS HUGEINT) || ' exceeds maximum 1000' END AS error FROM s) SELECT event_id, error IS NULL AS ok, error FROM r""")
def _(t):
    return _cypher(t).select("event_id", guard.error(F.col("q")).alias("error")).select("event_id", F.col("error").isNull().alias("ok"), "error")


@op("FLT19_limit", rf"""
WITH {_CYPHER_SQL} SELECT event_id, CASE WHEN NOT contains(upper(q), 'LIMIT') THEN rtrim(q, E' \n\t') || ' LIMIT 100'
  WHEN CAST('0' || regexp_extract(upper(q), 'LIMIT\s+(\d+)', 1) AS HUGEINT) > 1000 THEN regexp_replace(q, '(?i)LIMIT\s+\d+', 'LIMIT 1000', 'g') ELSE q END AS q FROM q""")
def _(t):
    return _cypher(t).select("event_id", guard.limited(F.col("q")).alias("q"))


@op("FLT20_tenant_predicate")
def _(t):
    return _cypher(t).select("event_id", guard.scoped(F.col("q")).alias("s")).select("event_id", "s.q", "s.error")
