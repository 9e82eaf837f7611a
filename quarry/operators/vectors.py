"""Vector retrieval: exact cosine top-k with payload filters, in higher-order functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries of a batch search that meet in one group at most, about.
SHARD_ROWS, QUERY_ROWS = 8192, 512
ENTITY_FLOOR, SUMMARY_FLOOR, CHUNK_FLOOR = 0.78, 0.72, 0.65


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def vector(values) -> Column:
    """A query vector as a literal."""
    return F.array(*[F.lit(float(x)) for x in values])


def matching(must: dict | None = None, any_of: dict | None = None, must_not: dict | None = None, at_least: dict | None = None) -> Column:
    """A payload filter: equality, any-of, exclusion (null stays) and lower bounds, all and-ed."""
    parts = [F.col(k) == v for k, v in (must or {}).items()]
    parts += [F.col(k).isin(*v) for k, v in (any_of or {}).items()]
    parts += [F.coalesce(~F.col(k).isin(*v), F.lit(True)) for k, v in (must_not or {}).items()]
    parts += [F.col(k) >= v for k, v in (at_least or {}).items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def compile_filter(conditions: dict) -> Column:
    """{"must": [{"key", "match": {"value" | "any"}}], "must_not": [...]} as a column."""

    def one(c: dict) -> Column:
        match = c["match"]
        return F.col(c["key"]).isin(*match["any"]) if "any" in match else F.col(c["key"]) == match["value"]

    parts = [one(c) for c in conditions.get("must", [])] + [F.coalesce(~one(c), F.lit(True)) for c in conditions.get("must_not", [])]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def top_k(rows: DataFrame, query: Column, k: int, where: Column | None = None, floor: float | None = None, id_col: str = "id", embedding: str = "embedding", digits: int = 6) -> DataFrame:
    """The k rows of highest cosine, ties to the smaller id: filter below a TakeOrderedAndProject."""
    found = (rows if where is None else rows.where(where)).withColumn("score", F.round(cosine(F.col(embedding), query), digits))
    found = found.orderBy(F.desc("score"), id_col).limit(k)
    return found if floor is None else found.where(F.col("score") >= floor)


def top_k_each(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", digits: int = 6, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best rows of each query (query_id, query), however many: blocks of queries meet shards of rows by an equi-join, and no pair of them grows with the input."""
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, shard_rows), (queries, query_rows)))
    lane = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    sharded = rows.withColumn("__shard", lane(shards, id_col, "embedding")).withColumn("__block", each(blocks))
    blocked = queries.withColumn("__block", lane(blocks, "query_id", "query")).withColumn("__shard", each(shards))
    scored = sharded.join(blocked, ["__shard", "__block"]).drop("__shard", "__block").withColumn("score", F.round(cosine(F.col("embedding"), F.col("query")), digits))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def triplet_importance(triplets: DataFrame, distances: DataFrame, k: int, touches: Column, penalty: float = 3.5, bias: float = 0.7) -> DataFrame:
    """The k triplets (src, rel, dst) of the smallest sum of distances (id, distance); an element without one counts the penalty, and the sum is scaled by the bias where a triplet touches a chunk."""
    for end in ("src", "rel", "dst"):
        triplets = triplets.join(distances.select(F.col("id").alias(end), F.col("distance").alias(f"d_{end}")), end, "left")
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"d_{end}"), F.lit(penalty)) for end in ("src", "rel", "dst")))
    scaled = total * F.when(touches, bias).otherwise(1.0)
    return triplets.select("src", "rel", "dst", F.round(scaled, 5).alias("importance")).orderBy("importance", "src", "rel", "dst").limit(k)


def best_per_key(groups: DataFrame, k: int, key: str = "id") -> DataFrame:
    """Max score per id over several result lists, then the global top k in order of first appearance on ties."""
    best = groups.groupBy(key).agg(F.max("score").alias("score"), F.min("first_order").alias("first_order"))
    return best.orderBy(F.desc("score"), "first_order", key).limit(k)


def distance_and_score(cos: Column) -> tuple[Column, Column]:
    """distance = 1 - cosine (lower is better) and score = 1 - distance."""
    return F.lit(1.0) - cos, cos
