r"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Method: a source's target is its weight's share of all words, at most ``cap`` times its own words; the excess goes to the
others by weight (water filling, one sort of the table of sources).  Each document then expects target / source words
copies.  Documents of a source stand in a fixed order by size class, so that a systematic sample takes sizes evenly; the
prefix sum of expected copies plus one offset a source crosses an integer once per copy to emit.

The order is (size class, lane, digest): a class holds sizes within about a tenth of each other, a lane is one of LANES
parts of a class by a digest of doc_id.  Rows are ranked inside a (source, class, lane), and only the counts of those
groups, at most LANES * some 200 a source however many documents there are, are summed along a source.  So a source that
holds a third of all rows, or copies of one size, is spread over many tasks.

Defined results: a null text has size 0; so have empty ones; they get copies like others and take no words.  A null source
is a source, last in the order.  Repeated rows each count.  An empty table gives an empty table.  Output columns replace
columns of the same name.  The same input gives the same result: offsets and order come from digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Own, table, written

WEIGHTS = (5, 2, 1)
CAP = 3
LANES = 32
SEED = "mix-1"


def _fraction(text) -> F.Column:
    """A number in [0, 1) from a digest, in steps of 2^-32."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (source, words) per source: (source, words, target, rate).  Works on the table of sources, one row each."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    s = sizes.withColumn("w", F.get(cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    # filled up in the order of cap * words / weight: the first k sources are full when the level of the rest reaches them
    by_ratio = Window.orderBy((F.lit(cap) * F.col("words") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("__full", F.coalesce(F.sum("words").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap)
    s = s.withColumn("__rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("__level", (F.sum("words").over(everything) - F.col("__full")).cast("double") / F.col("__rest"))
    # the level is that of the first source that does not fill up
    open_ = F.when(F.col("__level") * F.col("w") <= F.lit(cap) * F.col("words"), F.struct((F.lit(cap) * F.col("words") / F.col("w")).alias("ratio"), F.col("__level").alias("level")))
    s = s.withColumn("__at", F.min(open_).over(everything)["level"])
    target = F.least((F.lit(cap) * F.col("words")).cast("double"), F.col("__at") * F.col("w"))
    s = s.withColumn("target", F.coalesce(target, (F.lit(cap) * F.col("words")).cast("double")))
    return s.select("source", "words", "target", F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies * size)."""
    out = ["size", "source_size", "target", "copies", "taken"]
    own = Own(docs, results=out)
    base = own.rows.select(
        *own.columns,
        F.md5(F.coalesce(own.at(text), F.lit(""))).alias("__body"),
        F.regexp_count(F.coalesce(own.at(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(own.at(doc_id).cast("string"), F.lit("")))).alias("__digest"),
        F.coalesce(F.concat(F.lit("="), own.at(source)), F.lit("")).alias("__source"),
    )
    base = base.withColumn("__class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 8)).otherwise(F.lit(-1)).cast("int"))
    base = base.withColumn("__lane", F.conv(F.substring("__digest", 31, 2), 16, 10).cast("int") % LANES)
    key = ["__source", "__class", "__lane"]
    groups = base.groupBy(*key).agg(F.count("*").alias("__n"), F.sum("size").alias("__words"))
    groups, _ = written(groups)  # read twice; without it each of both would count the words of every text again
    words = groups.groupBy("__source").agg(F.sum("__words").alias("words"))
    targets = source_targets(words.select(F.expr("if(__source = '', null, substring(__source, 2))").alias("source"), "words"), weights, cap)
    targets = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("__source"), F.col("words").alias("source_size"), "target", F.col("rate").alias("__rate"))
    before = Window.partitionBy("__source").orderBy("__class", "__lane").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n", "__words").join(targets, "__source")
    ranked = base.withColumn("__row", F.row_number().over(Window.partitionBy(*key).orderBy("__digest", "__body"))).join(placed, key)
    offset = _fraction(F.concat(F.lit(seed + "/"), F.col("__source")))
    upto = lambda rows: F.floor(F.col("__rate") * rows + offset)
    rank = F.col("__before") + F.col("__row")
    ranked = ranked.withColumn("copies", (upto(rank.cast("double")) - upto((rank - 1).cast("double"))).cast("long"))
    ranked = ranked.withColumn("taken", F.col("copies") * F.col("size"))
    return own.restored(ranked, *out)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix over all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH base AS (
  SELECT doc_id, '=' || source AS src0, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest, md5(coalesce(text, '')) AS body
  FROM documents),
b AS (
  SELECT *, coalesce(src0, '') AS src, CASE WHEN size > 0 THEN CAST(floor(log2(CAST(size AS DOUBLE)) * 8) AS INT) ELSE -1 END AS class,
         CAST('0x' || substr(digest, 31, 2) AS INT) % 32 AS lane FROM base),
s0 AS (SELECT source, src, CAST(sum(size) AS BIGINT) AS words FROM b GROUP BY 1, 2),
s1 AS (SELECT *, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1) AS w FROM s0),
s2 AS (SELECT *, 3 * words / w AS ratio,
         coalesce(sum(words) OVER (ORDER BY 3 * words / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 AS full_,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3 * words / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(words) OVER () AS total FROM s1),
s3 AS (SELECT *, CAST(total - full_ AS DOUBLE) / CAST(rest AS DOUBLE) AS lvl FROM s2),
s4 AS (SELECT *, (SELECT lvl FROM s3 WHERE lvl * w <= 3 * words ORDER BY ratio, lvl LIMIT 1) AS filled FROM s3),
s5 AS (SELECT source, src, words, coalesce(least(CAST(3 * words AS DOUBLE), filled * w), CAST(3 * words AS DOUBLE)) AS target FROM s4),
r AS (
  SELECT b.doc_id, b.size, s5.words AS source_size, s5.target, CASE WHEN s5.words > 0 THEN s5.target / s5.words ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY b.src ORDER BY b.class, b.lane, b.digest, b.body) AS rank,
         CAST(CAST('0x' || substr(md5('mix-1/' || b.src), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM b JOIN s5 ON b.src = s5.src)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate * CAST(rank AS DOUBLE) + u) - floor(rate * CAST(rank - 1 AS DOUBLE) + u)) * size AS BIGINT) AS taken
FROM r
"""
