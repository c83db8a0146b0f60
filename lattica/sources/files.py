"""Landing files, tables of entities and edges, and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.ingest import edge_list_to_triples, table_to_triples
from lattica.operators.tables import EXTENSIONS, extension


def read_landing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files (path, ext, content) of supported kinds, and rejects (path, ext)."""
    files = spark.read.format("binaryFile").load(path).select("path", extension(F.col("path")).alias("ext"), "content")
    good = F.col("ext").isin(EXTENSIONS)
    return files.where(good), files.where(~good).select("path", "ext")


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def csv_to_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of entity tables with a header; all values are strings."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return table_to_triples(df, df.columns, [])


def json_to_triples(df: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Triples of a JSON text column: an array of objects, or an envelope data, items, results or nodes of one.

    keys are the keys of the objects, in order; values are texts, or arrays of texts. Texts are also split at commas.
    """
    fields = ", ".join(f"`{k}` string" for k in keys)
    parts = F.coalesce(*[F.get_json_object(raw, p) for p in ("$.data", "$.items", "$.results", "$.nodes")], F.col(raw))
    rows = df.withColumn("_rows", F.from_json(parts, f"array<struct<{fields}>>")).select(F.posexplode("_rows").alias("_at", "_row"))
    as_text = [F.coalesce(F.array_join(F.from_json(F.col(f"_row.`{k}`"), "array<string>"), "|"), F.col(f"_row.`{k}`")).alias(k) for k in keys]
    return table_to_triples(rows.select("_at", *as_text), keys, [], separators="[;|,]", order=F.col("_at"))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Triples of files with a header Person A, Relationship, Person B, City, Country."""
    return edge_list_to_triples(spark.read.csv(path, header=True, inferSchema=False), [])


def write_graph(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """Both tables as parquet, in a folder for each tenant; tenants not in the tables stay as they are."""
    for df, name in ((entities, "entities"), (relations, "relations")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_id").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations")


def export_graph(nodes: DataFrame, links: DataFrame, path: str) -> None:
    """Nodes and links as JSON lines."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    links.write.mode("overwrite").json(f"{path}/links")


def view_graph(nodes: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON object {nodes, links} for each key, of graphs small enough to look at (see ``full_graph``)."""
    pack = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c not in keys]))).alias(name))
    both = pack(nodes, "nodes").join(pack(links, "links"), keys, "full")
    return both.select(*keys, F.to_json(F.struct(F.coalesce("nodes", F.array()).alias("nodes"), F.coalesce("links", F.array()).alias("links"))).alias("graph"))
