"""A graph stored in hash buckets, of which an upsert rewrites those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.operators.graph import EDGE, upsert_entities, upsert_relations
from lattica.sources.shared import discard, stored

ENTITIES = "user_id string, name string, type string"
RELATIONS = "user_id string, source string, target string, type string, weight bigint, source_files array<string>"


class GraphStore:
    """Entities and relations under path, in folders by bucket; the number of buckets stays as it is first given.

    Entities lie by user and folded name, so that the case variants of a name are together; relations by all that
    identifies them, so that a hub's are spread. Buckets are a few tens of MB where their number suits the graph.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, *columns: Column) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, ddl: str, touched: list[int] | None = None) -> DataFrame:
        schema = StructType.fromDDL(f"{ddl}, bucket int")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if touched is None else rows.where(F.col("bucket").isin(touched))

    @property
    def entities(self) -> DataFrame:
        return self._read("entities", ENTITIES).drop("bucket")

    @property
    def relations(self) -> DataFrame:
        return self._read("relations", RELATIONS).drop("bucket")

    def _of_entity(self, name: str) -> Column:
        return self._bucket(F.col("user_id"), F.lower(name))

    def _of_relation(self, kind: str = "type") -> Column:
        return self._bucket(F.col("user_id"), F.lower("source"), F.lower("target"), F.col(kind))

    @staticmethod
    def _buckets_of(df: DataFrame) -> list[int]:
        return [r.bucket for r in df.select("bucket").distinct().collect()]  # no more than there are buckets

    def _matched(self, triples: DataFrame) -> DataFrame:
        """The triples with their names as the stored graph spells them; a new name is spelled as it first comes.

        Of several stored spellings that of the triple is taken, if it is one of them, else the smallest.
        """
        ends = triples.select("user_id", F.explode(F.array(F.struct(F.col("source").alias("name"), F.struct("seq", F.lit(0).alias("side")).alias("at")), F.struct(F.col("target").alias("name"), F.struct("seq", F.lit(1).alias("side")).alias("at")))).alias("e"))
        names = stored(ends.select("user_id", "e.*").groupBy("user_id", "name").agg(F.min("at").alias("at")).withColumn("low", F.lower("name")).withColumn("bucket", self._of_entity("name")), "names")
        held = self._read("entities", ENTITIES, self._buckets_of(names)).select("user_id", F.col("name").alias("spelled"), F.lower("name").alias("low"))
        known = held.groupBy("user_id", "low").agg(F.min("spelled").alias("spelled"))
        exact = held.select("user_id", F.col("spelled").alias("name"), F.lit(True).alias("same"))
        first = names.groupBy("user_id", "low").agg(F.min_by("name", "at").alias("first"))
        to = names.join(exact, ["user_id", "name"], "left").join(known, ["user_id", "low"], "left").join(first, ["user_id", "low"])
        to = stored(to.select("user_id", "name", F.when(F.col("same"), F.col("name")).otherwise(F.coalesce("spelled", "first")).alias("to")), "spelled")
        out = triples
        for end in ("source", "target"):
            out = out.join(to.withColumnRenamed("name", end), ["user_id", end]).drop(end).withColumnRenamed("to", end)
        out = stored(out.select(triples.columns), "matched")
        discard(names, to)
        return out

    def upsert(self, triples: DataFrame, match: str = "exact") -> GraphStore:
        """Add triples (user_id, source_file, seq, source, source_type, relation, target, target_type), as ``upsert_entities`` and ``upsert_relations`` do.

        With match ``case_insensitive``, names that differ from a stored one in case alone are that one. Buckets without a
        name or relation of the triples are neither read nor written. What replaces the others is stored whole before
        the first of them is written. Triples with a null user or name add nothing.
        """
        if match not in ("exact", "case_insensitive"):
            raise ValueError(f"no such match: {match}")
        whole = triples.where("user_id IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL")
        rows = self._matched(whole) if match == "case_insensitive" else whole
        names = rows.select("user_id", F.explode(F.array("source", "target")).alias("name")).select(self._of_entity("name").alias("bucket"))
        old = self._read("entities", ENTITIES, self._buckets_of(names)).drop("bucket")
        entities = stored(upsert_entities(rows, old).withColumn("bucket", self._of_entity("name")), "entities")
        links = rows.select(self._of_relation("relation").alias("bucket"))
        old = self._read("relations", RELATIONS, self._buckets_of(links)).select(*EDGE, "weight", "source_files")
        relations = stored(upsert_relations(rows, old).withColumn("bucket", self._of_relation()), "relations")
        for df, name in ((entities, "entities"), (relations, "relations")):
            df.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
        discard(entities, relations, rows if match == "case_insensitive" else None)
        return self
