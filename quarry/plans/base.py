"""Registration of queries, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, and the property graph over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def nodes(self) -> DataFrame:
        """(id, label, name, scope): regions to suppliers and parts; scope is the nation or part type."""
        s = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
        out = self.region.select(s("r", "r_regionkey").alias("id"), F.lit("region").alias("label"), F.col("r_name").alias("name"), F.lit("world").alias("scope"))
        out = out.unionByName(self.nation.select(s("n", "n_nationkey").alias("id"), F.lit("nation").alias("label"), F.col("n_name").alias("name"), s("r", "n_regionkey").alias("scope")))
        out = out.unionByName(self.supplier.select(s("s", "s_suppkey").alias("id"), F.lit("supplier").alias("label"), F.col("s_name").alias("name"), s("n", "s_nationkey").alias("scope")))
        out = out.unionByName(self.customer.select(s("c", "c_custkey").alias("id"), F.lit("customer").alias("label"), F.col("c_name").alias("name"), s("n", "c_nationkey").alias("scope")))
        return out.unionByName(self.part.select(s("p", "p_partkey").alias("id"), F.lit("part").alias("label"), F.col("p_name").alias("name"), F.col("p_type").alias("scope")))

    def edges(self) -> DataFrame:
        """(src, rel, dst): part to supplier, supplier and customer to nation, nation to region."""
        s = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
        out = self.lineitem.select(s("p", "l_partkey").alias("src"), F.lit("supplied_by").alias("rel"), s("s", "l_suppkey").alias("dst")).distinct()
        out = out.unionByName(self.supplier.select(s("s", "s_suppkey").alias("src"), F.lit("in_nation").alias("rel"), s("n", "s_nationkey").alias("dst")))
        out = out.unionByName(self.customer.select(s("c", "c_custkey").alias("src"), F.lit("in_nation").alias("rel"), s("n", "c_nationkey").alias("dst")))
        return out.unionByName(self.nation.select(s("n", "n_nationkey").alias("src"), F.lit("in_region").alias("rel"), s("r", "n_regionkey").alias("dst")))

    def query_vector(self, vec_id: int = 0) -> list[float]:
        """One row, looked up by id."""
        return self.embeddings.where(F.col("vec_id") == vec_id).select("embedding").first()[0]


GRAPH_SQL = """
nodes AS (
  SELECT 'r' || r_regionkey AS id, 'region' AS label, r_name AS name, 'world' AS scope FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'customer', c_name, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'p' || p_partkey, 'part', p_name, p_type FROM part),
edges AS (
  SELECT DISTINCT 'p' || l_partkey AS src, 'supplied_by' AS rel, 's' || l_suppkey AS dst FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'in_nation', 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'in_nation', 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'in_region', 'r' || n_regionkey FROM nation),
both_ways AS (
  SELECT src AS node, rel, dst AS other, true AS outgoing FROM edges UNION ALL SELECT dst, rel, src, false FROM edges)
"""
COSINE_SQL = "round(list_cosine_similarity([CAST(x AS DOUBLE) FOR x IN embedding], [CAST(x AS DOUBLE) FOR x IN (SELECT embedding FROM embeddings WHERE vec_id = 0)]), 6)"


def op(name: str, sql: str | None = None):
    """Registers a query of Tables under a name, with its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
