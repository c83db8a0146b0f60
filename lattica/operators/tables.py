"""Conversations, documents, tenancy, quotas and limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lattica.functions.text import trim
from lattica.operators.graph import best
from lattica.operators.ranks import numbered, recent
from lattica.operators.search import containing

STATUSES = ["Processing", "Completed", "Failed"]
EXTENSIONS = ["docx", "txt", "csv", "xlsx", "xls", "pdf"]


def tenant_scope(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of the given users."""
    return df.join(users.select("user_id").distinct(), "user_id", "left_semi")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def validate_upload(uploads: DataFrame, most: int = 2 << 20) -> DataFrame:
    """Adds reject_reason to (user_id, path, size): null, or 'extension', '422 empty', '413 too large' or 'path'."""
    reason = F.when(~extension(F.col("path")).isin(EXTENSIONS), "extension").when(F.col("size") == 0, "422 empty").when(F.col("size") > most, "413 too large").when(~F.startswith("path", F.concat("user_id", F.lit("/"))), "path")
    return uploads.withColumn("reject_reason", reason)


def status_violations(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("status").isNull() | ~F.col("status").isin(STATUSES))


def stuck_documents(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("status").isin("Processing", "Failed"))


def register_documents(documents: DataFrame) -> DataFrame:
    return documents.withColumns({"status": F.lit("Processing"), "created_at": F.current_timestamp()})


def status_counts(documents: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]
    return documents.groupBy("user_id").agg(*counts)


def search_titles(conversations: DataFrame, requests: DataFrame) -> DataFrame:
    """(req_id, id) of conversations of the user whose title, 'New conversation' if null, contains q in any case; an empty q is in every title."""
    titles = conversations.select("user_id", "id", F.lower(F.coalesce("title", F.lit("New conversation"))).alias("low"))
    asked = requests.select("req_id", "user_id", F.lower("q").alias("q"))
    every = asked.where("q = ''").join(titles, "user_id")
    return containing(asked, titles, "q", "low").select("req_id", "id").unionByName(every.select("req_id", "id"))


def messages_of_owner(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages whose conversation belongs to their caller (user_id)."""
    return messages.join(conversations.select(F.col("id").alias("conversation_id"), "user_id"), ["conversation_id", "user_id"], "left_semi")


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted, key, "left_anti")


def derive_siblings(persons: DataFrame) -> DataFrame:
    """Unordered pairs (a, b) of persons (tenant, id, father) with the same father."""
    known = persons.where("father IS NOT NULL")
    a, b = known.select("tenant", "father", F.col("id").alias("a")), known.select("tenant", "father", F.col("id").alias("b"))
    return a.join(b, ["tenant", "father"]).where("a < b").select("tenant", "a", "b")


def symmetric_pairs(pairs: DataFrame) -> DataFrame:
    """One row for each relation and unordered pair."""
    return pairs.select("relation", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def conversation_recency(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """updated_at is that of the latest message, if later."""
    last = messages.groupBy("conversation_id").agg(F.max("created_at").alias("last"))
    return conversations.join(last, conversations["id"] == last["conversation_id"], "left").select(*[F.greatest("updated_at", F.coalesce("last", "updated_at")).alias("updated_at") if c == "updated_at" else F.col(c) for c in conversations.columns])


def history_window(messages: DataFrame, n: int = 12, most: int = 400) -> DataFrame:
    """(conv_id, history): the last n messages in order, each cut to most characters, as 'User: ' and 'Assistant: ' lines."""
    last = best(messages, ["conv_id"], [F.desc("seq")], n)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring("content", 1, most))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


def document_quota(documents: DataFrame, most: int = 5) -> DataFrame:
    """Adds over_quota: the user already had ``most`` documents.

    The last document of each user that fits is found with a limit, which Spark applies before the shuffle; later
    ones are over it. So no window holds all documents of a user.
    """
    order = F.struct("created_at", "id")
    last = best(documents.select("user_id", "created_at", "id"), ["user_id"], [F.asc("created_at"), F.asc("id")], most).where(F.col("rank") == most).select(F.col("user_id").alias("_user"), order.alias("_last"))
    joined = documents.join(last, documents["user_id"].eqNullSafe(last["_user"]), "left")
    return joined.select(*[documents[c] for c in documents.columns], (F.col("_last").isNotNull() & (order > F.col("_last"))).alias("over_quota"))


def sliding_rate(events: DataFrame, limit: int, interval: str = "1 hour") -> DataFrame:
    """Adds n_recent, the user's events in the interval up to each event, and over_limit; a user's events are counted by slices of time (see ``recent``)."""
    counted = recent(events, "user_id", F.unix_micros("ts"), _micros(interval), "n_recent")
    return counted.withColumn("over_limit", F.col("n_recent") > limit)


def _micros(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def admit(events: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """Events (user_id, event_id, ts) with admitted: fewer than limit admitted events of the user in the seconds before.

    Admission depends on earlier admissions, so each task goes through its users' events in order, batch after batch,
    and holds no more than the last ``limit`` admitted times of one user. Events without a user or a time are not
    admitted; ties of time go by event_id.
    """
    ordered = events.withColumn("_at", F.unix_micros("ts")).repartition("user_id").sortWithinPartitions("user_id", "_at", "event_id")
    schema = StructType([*events.schema.fields, StructField("admitted", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, last = None, deque(maxlen=limit)
        for batch in batches:
            admitted = []
            for u, at in zip(batch.column("user_id").to_pylist(), batch.column("_at").to_pylist(), strict=True):
                if u != user:
                    user, last = u, deque(maxlen=limit)
                fits = u is not None and at is not None and (len(last) < limit or last[0] <= at - seconds * 1_000_000)
                if fits:
                    last.append(at)
                admitted.append(fits)
            kept = batch.select([f.name for f in schema.fields[:-1]])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(admitted)], [f.name for f in schema.fields])

    return ordered.mapInArrow(run, schema)


def list_documents(documents: DataFrame) -> DataFrame:
    """Newest first within each user; a user with many documents is numbered by ranges (see ``numbered``)."""
    return numbered(documents, ["user_id"], [F.desc("created_at"), F.asc("id")], "place")


def list_conversations(conversations: DataFrame, k: int = 50) -> DataFrame:
    return best(conversations, ["user_id"], [F.desc("updated_at"), F.asc("id")], k)


def conversation_messages(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """The messages of owned conversations, numbered in time order."""
    own = messages_of_owner(messages, conversations)
    return own.withColumn("place", F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at", "id")))


def rename_conversation(conversations: DataFrame, renames: DataFrame) -> DataFrame:
    """Titles replaced by trimmed new ones of at most 80 characters; blank ones are ignored."""
    new = renames.select("id", F.substring(trim(F.col("title")), 1, 80).alias("new")).where("new != ''")
    return conversations.join(new, "id", "left").select(*[F.coalesce("new", "title").alias("title") if c == "title" else F.col(c) for c in conversations.columns])
