"""Exact admission on a stream: fewer than so many admitted events of a user in the time before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import IntegralType, LongType, StringType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of queries that start from now on in RocksDB; a query with a checkpoint goes on with the store that this names."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Admission(StatefulProcessor):
    """State of a user: events that wait for the watermark, and the times of the last ``limit`` admitted ones.

    Admission depends on what was admitted before, so an event is decided once no earlier one can come. A timer of the
    user goes off when the watermark reaches the first event that waits; all up to the watermark are then decided in
    order. Another one drops the state when no event can need it.
    """

    def __init__(self, limit: int, seconds: int, numbers: bool):
        self.limit, self.micros, self.numbers = limit, seconds * 1_000_000, numbers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("event", StringType()), StructField("at", LongType())]))
        self.admitted = handle.getListState("admitted", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            frame = frame[frame["event"].notna()]
            timed = frame["at"].notna() & (key[0] is not None)
            if not timed.all():
                yield self._answers(key[0], frame.loc[~timed, ["event", "at"]], False)
            known = [(e, int(at)) for e, at in zip(frame.loc[timed, "event"].tolist(), frame.loc[timed, "at"].tolist(), strict=True)]
            if known:
                self.waiting.appendList(known)
                first = min([at for _, at in known] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(max(-(-first // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        events = [(at, e) for e, at in self.waiting.get()]
        due = sorted((x for x in events if x[0] <= reached), key=lambda x: (x[0], int(x[1]) if self.numbers else x[1]))
        later = [x for x in events if x[0] > reached]
        last = sorted(at for (at,) in self.admitted.get())
        admitted = []
        for at, _ in due:
            last = last[-self.limit :] if self.limit else []
            admitted.append(self.limit > 0 and (len(last) < self.limit or last[0] <= at - self.micros))
            if admitted[-1]:
                last.append(at)
        last = [at for at in last[-self.limit :] if at > reached - self.micros] if self.limit else []
        if due:
            self.waiting.put([(e, at) for at, e in later]) if later else self.waiting.clear()
            yield self._answers(key[0], pd.DataFrame({"event": [e for _, e in due], "at": [at for at, _ in due]}), admitted)
        self.admitted.put([(at,) for at in last]) if last else self.admitted.clear()
        if later:
            self.handle.registerTimer(-(-min(later)[0] // 1000))
        elif last:
            self.handle.registerTimer(-(-(last[-1] + self.micros) // 1000) + 1)

    def _answers(self, user, events: pd.DataFrame, admitted) -> pd.DataFrame:
        out = events.assign(user=user, admitted=admitted)[["user", "event", "at", "admitted"]]
        return out.astype({"at": "Int64", "admitted": bool})


def rate_limiter(events: DataFrame, limit: int, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, ts, admitted) of a stream: admitted if fewer than limit admitted events of the user lie in the seconds before.

    The answers are those of the batch form ``admit``, whatever batches the events come in: one is given once the
    watermark has reached its event, and ties of time go by event_id. Events later than ``late`` are dropped.
    Events without a user or a time are answered at once, as not admitted; rows without an event_id only move the watermark, for the end
    of a stream or a quiet one. The state of a user is what waits, and ``limit`` times at most; it is kept in RocksDB.
    """
    use_rocksdb(events.sparkSession)
    user, event = (events.schema[c].dataType for c in ("user_id", "event_id"))
    # as strings, since pandas makes floats of whole numbers beside nulls
    rows = events.select(F.col("user_id").cast("string").alias("user"), F.col("event_id").cast("string").alias("event"), "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    processor = Admission(limit, seconds, isinstance(event, IntegralType))
    found = rows.groupBy("user").transformWithStateInPandas(processor, "user string, event string, at long, admitted boolean", "append", "eventTime")
    return found.select(F.col("user").cast(user).alias("user_id"), F.col("event").cast(event).alias("event_id"), F.timestamp_micros("at").alias("ts"), "admitted")
