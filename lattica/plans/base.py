"""The knowledge graph that the star schema makes: triples, entities, relations, requests; as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.graph import upsert_entities, upsert_relations
from lattica.sources.files import read_graph, write_graph
from lattica.sources.shared import new_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers LOCATED_IN nations, nations PART_OF regions, suppliers SUPPLIES parts; the region is the tenant.

    Names of suppliers are in lower case for odd orders, so that there are case variants.
    """
    t = lambda n: table(spark, sf, n)
    region = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    lit = F.lit

    def rows(df, file, seq, source, source_type, relation, target, target_type):
        return df.select(F.col("r_name").alias("user_id"), file.alias("source_file"), seq.cast("long").alias("seq"), source.alias("source"), lit(source_type).alias("source_type"), lit(relation).alias("relation"), F.col(target).alias("target"), lit(target_type).alias("target_type"))

    customer = t("customer").join(region, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = t("supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey"))
    line = t("lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_orderkey") % 2 == 1, F.lower("s_name")).otherwise(F.col("s_name"))
    return (
        rows(customer, lit("customer"), F.col("c_custkey") * 10 + 1, F.col("c_name"), "Person", "LOCATED_IN", "n_name", "Location")
        .unionByName(rows(region, lit("nation"), F.col("n_nationkey") * 10 + 2, F.col("n_name"), "Entity", "PART_OF", "r_name", "Location"))
        .unionByName(rows(supplier, lit("supplier"), F.col("s_suppkey") * 10 + 3, F.col("s_name"), "Organization", "LOCATED_IN", "n_name", "Location"))
        .unionByName(rows(line, F.concat(lit("ship_"), F.year("l_shipdate")), F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10 + 1_000_000_000_004, name, "Organization", "SUPPLIES", "p_name", "Product"))
    )


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = triples(spark, sf)
    return upsert_entities(rows), upsert_relations(rows)


def stored_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The graph, upserted once, written by tenant and read again: for queries that look at it several times."""
    path = new_path(spark, "graph")
    write_graph(*graph(spark, sf), path)
    return read_graph(spark, path)


TRIPLES = """
t AS (
  SELECT r_name AS user_id, 'customer' AS source_file, c_custkey * 10 + 1 AS seq, c_name AS source, 'Person' AS source_type,
         'LOCATED_IN' AS relation, n_name AS target, 'Location' AS target_type
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT r_name, 'nation', n_nationkey * 10 + 2, n_name, 'Entity', 'PART_OF', r_name, 'Location'
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT r_name, 'supplier', s_suppkey * 10 + 3, s_name, 'Organization', 'LOCATED_IN', n_name, 'Location'
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT r_name, 'ship_' || CAST(year(l_shipdate) AS VARCHAR), l_orderkey * 1000 + l_linenumber * 10 + 1000000000004,
         CASE WHEN l_orderkey % 2 = 1 THEN lower(s_name) ELSE s_name END, 'Organization', 'SUPPLIES', p_name, 'Product'
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""

GRAPH = (
    TRIPLES
    + """,
ends AS (
  SELECT user_id, source AS name, source_type AS type, seq * 2 AS ord FROM t
  UNION ALL SELECT user_id, target, target_type, seq * 2 + 1 FROM t),
e AS (
  SELECT user_id, name, coalesce(arg_min(type, ord) FILTER (WHERE type <> 'Entity'), 'Entity') AS type FROM ends GROUP BY user_id, name),
r AS (
  SELECT user_id, source, target, relation AS type, count(*) AS weight, list_sort(list(DISTINCT source_file)) AS source_files
  FROM t GROUP BY user_id, source, target, relation),
sym AS (
  SELECT user_id, source AS node, target AS other, true AS is_forward, type, weight, source_files FROM r
  UNION ALL SELECT user_id, target, source, false, type, weight, source_files FROM r),
deg AS (SELECT user_id, node AS name, count(*) AS degree FROM sym GROUP BY user_id, node),
d AS (SELECT e.user_id, e.name, e.type, coalesce(degree, 0) AS degree FROM e LEFT JOIN deg ON e.user_id = deg.user_id AND e.name = deg.name)"""
)
