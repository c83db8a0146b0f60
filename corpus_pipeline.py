"""The corpus pipeline: STAGES applied to documents, each stage's result written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import store
from lattica.llm.decontaminate import contamination
from lattica.llm.jaccard import near_duplicates
from lattica.llm.language import identify, trained
from lattica.llm.line_dedup import drop_repeated_lines
from lattica.llm.pieces import digests, production_model


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go, null texts and texts without a letter among them; each row is judged by itself."""
    return identify(docs, trained(docs)).where("NOT rejected").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose the lines that an earlier document holds; n_chars is that of the text left."""
    found = drop_repeated_lines(docs)
    fields = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*[fields.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the smallest doc_id of each component stays; rows without an id stay.

    Rows that repeat an id are judged by their own texts: each stays if its id leads the component that its text is in.
    Rows equal in id and text stay or go together. Texts without words, or null, are alike to nothing and stay.
    """
    found = near_duplicates(docs)
    leaders = store(found.where("doc_id = component_id").select(F.col("doc_id").alias("leader_id"), F.col("copy").alias("leader_copy")).distinct(), "leaders")
    leads = (F.col("row.doc_id") == F.col("leader_id")) & (F.xxhash64(F.col("row.text").cast("binary")) == F.col("leader_copy"))
    rows = docs.where("doc_id IS NOT NULL").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(leaders, leads, "left_semi").select("row.*").unionByName(docs.where("doc_id IS NULL"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go, with all rows that repeat their ids; null texts and rows without an id stay."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=0)
    bad = store(found.where("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding: token counts and digests of each text."""
    return digests(docs, production_model())


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", duplicates), ("benchmark decontamination", benchmark), ("SentencePiece encoding and decoding", tokens)]

#: SQL can express neither the centroids nor the SentencePiece merges; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result on the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
