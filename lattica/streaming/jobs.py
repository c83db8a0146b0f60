"""Event-driven jobs. Each keeps its result in files of its own batch, so that a repeated batch replaces itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.graph import upsert_relations
from lattica.streaming.tiers import Tiered


#: Ids of events, and the latest time of a batch beside a null is_id.
IDS = "event_id string, ts timestamp, is_id boolean"


def _mark(ids: DataFrame, late: str) -> Column | None:
    """The latest time of the batches that wrote ids, less the lateness."""
    top = ids.where("is_id IS NULL").agg(F.max(F.unix_micros("ts"))).first()[0]
    return None if top is None else F.timestamp_micros(F.lit(top)) - F.expr(f"interval {late}")


def _alive(ids: DataFrame, mark: Column | None, late: str) -> DataFrame:
    """The ids that an event after the watermark may repeat."""
    return ids if mark is None else ids.where(F.col("is_id").isNull() | F.col("ts").isNull() | (F.col("ts") + F.expr(f"interval {late}") > mark))


def fresh_events(events: DataFrame, ids: Tiered, number: int, late: str = "1 hour") -> DataFrame:
    """The events (event_id, ts) of a batch without repeats of an id within the lateness, and without those the watermark has passed.

    The watermark is the latest time of the batches before, less the lateness. Earlier ids are joined from where
    ``record_events`` has put them, in a shuffle that goes to disk where it has to: no executor holds them. Of
    repeats in a batch the first by time stays. Null ids are one id; events without a time are not late.
    """
    seen = ids.rows(number)
    mark = _mark(seen, late) if ids.before(number) else None
    timely = events if mark is None else events.where(F.col("ts").isNull() | (F.col("ts") > mark))
    timely = timely.withColumn("_id", F.col("event_id").cast("string"))
    first = timely.withColumn("_nth", F.row_number().over(Window.partitionBy("_id").orderBy("ts"))).where("_nth = 1")
    if ids.before(number):
        known = _alive(seen, mark, late).where("is_id").select(F.col("event_id").alias("_known"))
        first = first.join(known, F.col("_id").eqNullSafe(F.col("_known")), "left_anti")
    return first.drop("_id", "_nth")


def record_events(events: DataFrame, fresh: DataFrame, ids: Tiered, number: int) -> None:
    """Keep the ids of a batch, those that are fresh, and its latest time; parts that are folded lose the ids that no event can repeat."""
    new = fresh.select(F.col("event_id").cast("string").alias("event_id"), "ts", F.lit(True).alias("is_id"))
    latest = events.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("string").alias("event_id"), "ts", F.lit(None).cast("boolean").alias("is_id"))
    ids.write(new.unionByName(latest), number)


def graph_deltas(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What triples add to a graph: for each name its first type that is not 'Entity', and where it came; weights and files of relations."""
    ends = triples.select("user_id", F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("source_type").alias("type"), F.struct("seq", F.lit(0).alias("side")).alias("at")), F.struct(F.col("target").alias("name"), F.col("target_type").alias("type"), F.struct("seq", F.lit(1).alias("side")).alias("at")))).alias("e")).select("user_id", "e.*")
    at = F.when(F.col("type") != "Entity", F.col("at"))
    return ends.groupBy("user_id", "name").agg(F.min_by("type", at).alias("type"), F.min(at).alias("at")), upsert_relations(triples)


def ingest_stream(triples: DataFrame, path: str, checkpoint: str, late: str = "1 hour"):
    """A query that adds up triples (with event_id, ts) as graph deltas under path, a folder of entities and one of relations for each batch.

    ``streamed_graph`` folds the deltas. A batch that runs again overwrites its folders, so nothing counts twice. The ids
    that have come lie under path too, in parts that are folded in tiers; there is no state in executors.
    """

    def write(batch: DataFrame, number: int) -> None:
        ids = Tiered(batch.sparkSession, f"{path}/ids", IDS, lambda rows: _alive(rows, _mark(rows, late), late))
        fresh = fresh_events(batch, ids, number, late).persist()
        for delta, name in zip(graph_deltas(fresh), ("entities", "relations"), strict=True):
            delta.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        record_events(batch, fresh, ids, number)
        fresh.unpersist()

    return triples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def streamed_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of all batches so far: a row for each name or relation of a batch is folded, not each triple."""
    e, r = (spark.read.parquet(f"{path}/{name}").drop("batch") for name in ("entities", "relations"))
    entities = e.groupBy("user_id", "name").agg(F.coalesce(F.min_by("type", "at"), F.lit("Entity")).alias("type"))
    files = F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_files"))))
    return entities, r.groupBy("user_id", "source", "target", "type").agg(F.sum("weight").alias("weight"), files.alias("source_files"))


def latest_status(changes: DataFrame) -> DataFrame:
    """The state of each document after its changes (document_id, user_id, version, kind, status): that of the highest version."""
    return changes.groupBy("user_id", "document_id").agg(F.max_by("status", F.struct("version", "kind", "status")).alias("status"), F.max("version").alias("version"))


#: Batches of the status feed after which all changes so far are folded into one.
FOLDED = 20


def _changes(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and path of each folder of changes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(place)] if files.exists(place) else []
    return sorted((int(p.getName().split("=")[1]), p.toString()) for p in found if p.getName().startswith("changes="))


def document_status_feed(changes: DataFrame, path: str, checkpoint: str):
    """A query that writes, for each batch, the latest state of the documents that it changes; ``document_status`` folds them.

    Every FOLDED batches the changes so far become one folder, and those before the last such folder are deleted, so
    neither writing nor reading grows with the number of batches. A batch that runs again overwrites its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("user_id", "document_id", "version", "kind", "status")
        if number and number % FOLDED == 0:
            old = [p for n, p in _changes(spark, path) if n < number]
            if old:
                rows = rows.unionByName(spark.read.parquet(*old))
        rows.groupBy("user_id", "document_id").agg(F.max_by(F.struct(*rows.columns[2:]), F.struct("version", "kind", "status")).alias("row")).select("user_id", "document_id", "row.*").write.mode("overwrite").parquet(f"{path}/changes={number}")
        if number and number % FOLDED == 0:
            for n, p in _changes(spark, path):
                if n < number - FOLDED:
                    place = spark._jvm.org.apache.hadoop.fs.Path(p)
                    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def document_status(spark: SparkSession, path: str) -> DataFrame:
    """The state of each document so far, from the folders that a feed has written."""
    return latest_status(spark.read.parquet(*[p for _, p in _changes(spark, path)]))
