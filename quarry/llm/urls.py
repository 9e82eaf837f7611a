r"""URL parts, rules and listed URLs, in DataFrame functions only.

Method: canonical listed URLs fill a blocked Bloom filter of 256-bit blocks, one for every PER_BLOCK of them (counted first),
each URL eight bits of one block.  URLs that miss a bit are not listed.  The filter is broadcast up to MAX_BROADCAST blocks
(some 3 MB, a list of a million URLs) and joined by a shuffle beyond.  Possible hits alone
are shuffled to an exact hash join with the list, which removes false positives.  Rules (host, path) come first: they fit the
host and its subdomains and paths that begin with the rule's; the longest rule wins.

Canonical: host with A-Z lower-cased, without ``www.`` and default ports; path without slashes at its end; query parameters
sorted, without utm_*, ref, fbclid and gclid; no scheme, no fragment.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and is never listed (allow);
repeated rows are judged each; empty tables give none; of rules as long as each other the one with the longer host wins;
null or empty list entries are ignored; other columns stay, columns of the results' names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Own, let, table, written

PER_BLOCK = 16
MAX_BROADCAST = 1 << 16
#: Keys over which pages without host are dealt.
NOWHERE = 4096
LITERAL_RULES = 1000
#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Host labels whose https URLs stand for a published list in the query.
LISTED_LABELS = ("spam-farm", "cheap-pills")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical form; empty where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING))), "&")
    full = F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.coalesce(F.when(host != "", full), F.lit(""))


def rules_column(spark: SparkSession, rules) -> Column:
    """The rules as an array of (h, p, v): a literal, beyond LITERAL_RULES the one row of a local relation, so that plans don't hold them."""
    kind = "array<struct<h:string,p:string,v:string>>"
    if len(rules) > LITERAL_RULES:
        return spark.createDataFrame([([tuple(r) for r in rules],)], f"rules {kind}").scalar()
    return F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v")) for h, p, v in rules]).cast(kind)


def rule_for(host: Column, path: Column, rules: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    fits = F.filter(rules, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(F.transform(fits, lambda r: F.struct((F.length(r["h"]) + F.length(r["p"])).alias("size"), F.length(r["h"]).alias("wide"), F.concat(r["h"], r["p"]).alias("rule"), r["v"].alias("verdict"))))


def blocks_for(n: int) -> int:
    return max(1, -(-n // PER_BLOCK))


def _bits(url: str, blocks: int) -> list[Column]:
    """A URL's block and its bits in the four words of the block."""
    block = F.expr(f"pmod(xxhash64({url}), {blocks}L)").alias("block")
    second = f"xxhash64({url}, 1)"
    bit = lambda at: f"shiftleft(1L, cast(shiftrightunsigned({second}, {at}) & 63L as int))"
    return [block, *[F.expr(f"{bit(12 * i)} | {bit(12 * i + 6)}").alias(f"m{i}") for i in range(4)]]


def bloom(listed: DataFrame, blocks: int, url: str = "canon") -> DataFrame:
    """The filter: at most ``blocks`` rows (block, four words)."""
    return listed.select(*_bits(url, blocks)).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)])


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", listed_url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule and verdict."""
    out = ["host", "path", "rule", "verdict"]
    own = Own(pages, results=out)
    names = listed.select(canonical(F.col(listed_url)).alias("__listed")).where("__listed <> ''").distinct()
    names, _ = written(names)  # read three times, and counted
    blocks = blocks_for(names.count())
    rows = own.rows.select(*own.columns, *[part(own.at(url)).alias(c) for part, c in ((host_of, "host"), (path_of, "path"), (canonical, "__canon"))], rules_column(pages.sparkSession, rules).alias("__rules"))
    rows = rows.withColumn("__rule", rule_for(F.col("host"), F.col("path"), F.col("__rules"))).drop("__rules").select("*", *[b.alias(f"__{n}") for b, n in zip(_bits("__canon", blocks), ("block", "m0", "m1", "m2", "m3"))])
    seen = bloom(names, blocks, "__listed").select(*[F.col(c).alias(f"__{c}") for c in ("block", "w0", "w1", "w2", "w3")])
    if blocks > MAX_BROADCAST:  # pages without host are never listed, and may be many: no one key for them
        rows = rows.withColumn("__block", F.when(F.col("__canon") != "", F.col("__block")).otherwise(-1 - F.monotonically_increasing_id() % NOWHERE))
    rows = rows.join(F.broadcast(seen) if blocks <= MAX_BROADCAST else seen, "__block", "left")
    hit = F.col("__rule").isNull() & (F.col("__canon") != "")
    for i in range(4):
        hit = hit & (F.coalesce(F.col(f"__w{i}"), F.lit(0)).bitwiseAND(F.col(f"__m{i}")) == F.col(f"__m{i}"))
    final = [*own.columns, "host", "path", F.col("__rule")["rule"].alias("rule")]
    sure = rows.where(~hit).select(*final, F.coalesce(F.col("__rule")["verdict"], F.lit("allow")).alias("verdict"))
    possible = rows.where(hit).join(names.hint("shuffle_hash"), F.col("__canon") == F.col("__listed"), "left")
    return own.restored(sure.unionByName(possible.select(*final, F.when(F.col("__listed").isNotNull(), "block").otherwise("allow").alias("verdict"))), *out)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; the https pages of listed hosts stand for a published list."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = F.split(host_of(F.col("url")), r"\.")
    listed = pages.where(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in LISTED_LABELS])) & F.col("url").startswith("https://"))
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


_PARTS_SQL = r"""
u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '') AS query FROM u),
q AS (SELECT *, array_to_string(list_sort([p FOR p IN string_split(query, '&') IF p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')]), '&') AS kept,
             regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') AS bare FROM h),
n AS (SELECT page_id, url, host, path, CASE WHEN bare = '' THEN '' ELSE bare || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canon FROM q)
"""

SQL = (
    "WITH "
    + _PARTS_SQL
    + r""",
listed AS (SELECT DISTINCT canon FROM n WHERE list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills']) AND url LIKE 'https://%' AND canon <> ''),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT n.*, (SELECT max(struct_pack(size := length(h) + length(p), wide := length(h), rule := h || p, verdict := v)) FROM rules
               WHERE (n.host = h OR suffix(n.host, '.' || h)) AND starts_with(n.path, p)) AS r FROM n)
SELECT page_id, host, path, r.rule AS rule, CASE WHEN r IS NOT NULL THEN r.verdict WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
)
