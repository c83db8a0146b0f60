"""Ingestion that document events trigger: from texts to a graph, each event once for all time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import cap_text
from lattica.operators.ingest import chunk_documents, extracted, pipeline_status, resolve_triples, resolve_types
from lattica.sources.shared import discard, stored
from lattica.streaming.jobs import graph_deltas
from lattica.streaming.ledger import Ledger
from lattica.streaming.tiers import Tiered

ENTITIES = "user_id string, name string, type string, at struct<seq:struct<ts:timestamp,doc_id:string,seq:bigint>,side:int>"
RELATIONS = "user_id string, source string, target string, type string, weight bigint, source_files array<string>"
DOCUMENTS = "user_id string, doc_id string, ts timestamp, status string, entity_count bigint, relation_count bigint"


def document_triples(documents: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Resolved triples of documents (doc_id, text): capped, cut into chunks, extracted, cleaned, typed, aliases and case resolved.

    ``extract`` adds ``raw`` to chunks (doc_id, chunk_idx, content): a hook for a model, or the rules of
    ``functions.baseline``. seq orders a document's triples. A null text has no triples. The extractor runs once: answers,
    typed and resolved triples are stored in turn, the first two until the last are.
    """
    capped = documents.select("doc_id", cap_text(F.col("text")).alias("c")).select("doc_id", F.col("c.text").alias("text")).where("text IS NOT NULL")
    answers = stored(extract(chunk_documents(capped)).select("doc_id", "chunk_idx", "raw"), "answers")
    entities, relations = extracted(answers, ["doc_id", "chunk_idx"])
    rows = relations.withColumn("seq", F.col("chunk_idx").cast("long") * (1 << 20) + F.col("pos"))
    typed = stored(resolve_types(rows, entities), "typed")
    out = stored(resolve_triples(typed), "triples")
    discard(answers, typed)
    return out


def merged_entities(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("user_id", "name").agg(F.min_by("type", "at").alias("type"), F.min("at").alias("at"))


def merged_relations(deltas: DataFrame) -> DataFrame:
    files = F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_files"))))
    return deltas.groupBy("user_id", "source", "target", "type").agg(F.sum("weight").alias("weight"), files.alias("source_files"))


class Ingestion:
    """The tables that a stream of document events keeps under path: entities and relations as deltas in tiers, documents, and the ledger."""

    def __init__(self, spark: SparkSession, path: str):
        self.ledger = Ledger(spark, f"{path}/ledger")
        self.entities = Tiered(spark, f"{path}/entities", ENTITIES, merged_entities)
        self.relations = Tiered(spark, f"{path}/relations", RELATIONS, merged_relations)
        self.documents = Tiered(spark, f"{path}/documents", DOCUMENTS)

    def apply(self, events: DataFrame, documents: DataFrame, extract: Callable[[DataFrame], DataFrame], number: int) -> None:
        """Ingest the documents of a batch of events (event_id, user_id, doc_id, source_file, ts) whose ids have not come before."""
        fresh = self.ledger.unseen(events, number).withColumn("doc_id", F.col("doc_id").cast("string")).persist()
        texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        wanted = texts.join(fresh.select("doc_id").distinct(), "doc_id", "left_semi")
        found = document_triples(wanted, extract)
        rows = fresh.join(found, "doc_id").withColumn("seq", F.struct("ts", "doc_id", "seq"))
        entities, relations = graph_deltas(rows)
        self.entities.write(entities, number)
        self.relations.write(relations, number)
        self.documents.write(pipeline_status(fresh.select("user_id", "doc_id", "ts"), found), number)
        self.ledger.record(fresh, number)
        fresh.unpersist()
        discard(found)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Entities and relations of the batches whose ids are recorded."""
        n = self.ledger.ids.size()
        entities = self.entities.read(n).select("user_id", "name", F.coalesce("type", F.lit("Entity")).alias("type"))
        return entities, self.relations.read(n)


def ingest_documents(events: DataFrame, documents: DataFrame, path: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame]):
    """A query that ingests the documents of a stream of events, each event_id once however late it comes again.

    A batch writes what its documents add, as parts of tables that are folded in tiers; it reads no part but those that
    it folds, and ids only where a Bloom filter of theirs answers. A batch that runs again replaces its parts, so nothing counts
    twice. Events without an id are left out; one whose document is missing or has no triples leaves it Failed.
    Two events with different ids for one document are two uploads: its weights count twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        Ingestion(batch.sparkSession, path).apply(batch, documents, extract, number)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
