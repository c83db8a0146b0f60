import json
import random
from datetime import datetime, timedelta

from lattica.functions.baseline import answer
from lattica.operators import graph as g
from lattica.operators import tables as tb
from lattica.streaming import statistics as st
from lattica.streaming import tiers
from lattica.streaming.documents import Ingestion, document_triples, ingest_documents
from lattica.streaming.ledger import Ledger
from lattica.streaming.limiter import rate_limiter
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def run_in_turn(spark, tmp_path, schema, slices, start):
    """Each slice is written, then the query runs from its checkpoint until it has read all."""
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint"), i)


def test_rate_limiter_is_the_batch_form(spark, tmp_path, limit=2):
    r = random.Random(limit)
    schema = "user_id string, event_id long, ts timestamp"
    slices = []
    for k in range(3):
        rows = [(r.choice(["a", "b", "c"]), 1000 * k + i, at(1000 * k + r.randrange(1000) + r.choice([0, 0.25]))) for i in range(40)]
        slices.append(rows + [rows[0][:1] + (1000 * k + 900,) + rows[0][2:]])  # a tie
    slices[1] += [(None, 5000, at(1500)), ("a", 5001, None)]
    beat = [(None, None, at(10_000_000))]

    def start(stream, checkpoint, _):
        found = rate_limiter(stream, limit, 120, "10 seconds")
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination(200)

    run_in_turn(spark, tmp_path, schema, [*slices, beat], start)
    got = sorted(((x.event_id, x.user_id, x.ts, x.admitted) for x in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    batch = tb.admit(spark.createDataFrame([x for s in slices for x in s], schema), limit, 120)
    assert got == sorted(((x.event_id, x.user_id, x.ts, x.admitted) for x in batch.collect()), key=str)
    assert {x[3] for x in got} == {True, False}


TRIPLES = "user_id string, source_file string, seq long, source string, source_type string, relation string, target string, target_type string"


def some_triples(r, n, first):
    name = lambda: r.choice("abcdefghijkl")
    kind = lambda: r.choice(["Entity", "Entity", "Person", "Place", None])
    return [(r.choice("uv"), r.choice(["f1", "f2", None]), first + i, name(), kind(), r.choice(["R", "S", "T"]), name(), kind()) for i in range(n)]


def test_statistics_after_each_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "FOLDED", 2)
    monkeypatch.setattr(st, "TOP_ENTITIES", 3)
    r = random.Random(2)
    whole, path = [], str(tmp_path / "state")
    key = lambda df: sorted(map(tuple, df.select("user_id", "metric", "key", "value", "rank").collect()), key=str)
    for k in range(4):
        # later batches bring earlier places too, which change types
        rows = [] if k == 1 else some_triples(r, 3 + 10 * k, 1000 - 100 * k if k % 2 else 1000 + 100 * k)
        batch = spark.createDataFrame(rows + rows[:2], TRIPLES)
        st.apply_batch(batch, path, k)
        if k == 2:
            st.apply_batch(batch, path, k)  # runs again
        whole += rows + rows[:2]
        entities, relations = g.upsert_entities(df := spark.createDataFrame(whole, TRIPLES)), g.upsert_relations(df)
        want = g.graph_stats(entities, relations).where("metric != 'top_entity' OR rank <= 3")
        assert key(st.statistics(spark, path)) == key(want)


def test_statistics_of_a_stream(spark, tmp_path):
    r = random.Random(3)
    slices = [some_triples(r, 12, 100 * k) for k in range(2)]
    slices[0].append((None, "f", 1, "x", "Entity", "R", "y", "Entity"))

    def start(stream, checkpoint, i):
        st.live_statistics(stream, str(tmp_path / "state"), checkpoint).trigger(availableNow=True).start().awaitTermination(200)

    run_in_turn(spark, tmp_path, TRIPLES, slices, start)
    df = spark.createDataFrame([x for s in slices for x in s], TRIPLES).where("user_id IS NOT NULL")
    assert sorted(map(tuple, st.statistics(spark, str(tmp_path / "state")).collect()), key=str) == sorted(map(tuple, g.graph_stats(g.upsert_entities(df), g.upsert_relations(df)).collect()), key=str)


def test_tiers(monkeypatch):
    for fan in (2, 3, 8):
        monkeypatch.setattr(tiers, "FAN", fan)
        alive = set()
        for number in range(200):
            held = tiers.parts(number)
            assert sum(map(tiers.cover, held)) == number and set(held) <= alive
            alive = (alive | {number + 1}) - set(tiers.folded(number))
        assert len(alive) <= 2 * fan * 8


def test_ledger(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tiers, "FAN", 2)
    r = random.Random(4)
    ledger, seen = Ledger(spark, str(tmp_path / "ledger")), set()
    for number in range(4):
        ids = [] if number == 1 else [f"e{r.randrange(60)}" for _ in range(25)]
        events = spark.createDataFrame([(i, at(r.randrange(100)), k) for k, i in enumerate(ids)] + [(None, at(1), 99)], "event_id string, ts timestamp, k int")
        fresh = ledger.unseen(events, number)
        assert {x.event_id for x in fresh.collect()} == set(ids) - seen and fresh.count() == len(set(ids) - seen)
        may = {x.event_id for x in ledger.maybe(spark.createDataFrame([(f"e{i}",) for i in range(60)], "event_id string"), number).collect()}
        assert seen <= may
        ledger.record(fresh, number)
        if number == 3:
            ledger.record(fresh, number)  # runs again
        seen |= set(ids)
    many = spark.range(5000).select(F.concat(F.lit("new"), "id").alias("event_id"))
    assert ledger.maybe(many, 4).count() < 60


TEXTS = [(1, "Ann Lee is a pilot. Lee was with Bob.\nPlane | flies to | Rome\nANN LEE was happy"), (2, "the Cat is the cat. 12 | is | 13"), (3, None), (4, ""), (5, "Bob is Bob | odd. " + "Ann Lee was here. " * 400), (6, "Ann is tall and Tom is small and Zoë was there")]


def rules(chunks):
    return chunks.withColumn("raw", answer(F.col("content"), ["is", "was"]))


def test_baseline_rules(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = {x.doc_id: x.raw and json.loads(x.raw) for x in df.select("doc_id", answer(F.col("text"), ["is", "was"]).alias("raw")).collect()}
    facts = lambda i: [(x["source"], x["relation"], x["target"]) for x in got[i]["relations"]]
    assert facts(1) == [("Plane", "flies to", "Rome"), ("Ann Lee", "is", "a pilot"), ("Lee", "was", "with Bob"), ("ANN LEE", "was", "happy")]
    assert [e["name"] for e in got[1]["entities"]] == ["Ann Lee", "Lee", "Bob", "Plane", "Rome", "ANN LEE"]
    assert facts(6) == [("Ann", "is", "tall and Tom"), ("small and Zoë", "was", "there")]
    assert got[3] is None and facts(4) == []
    assert answer(F.col("text"), []) is not None
    triples = {(x.doc_id, x.source, x.relation, x.target) for x in document_triples(df, rules).collect()}
    assert (1, "Ann Lee", "WAS", "with Bob") in triples and (1, "Ann Lee", "IS", "a pilot") in triples and (1, "Plane", "FLIES_TO", "Rome") in triples
    assert not any(d in (3, 4) for d, *_ in triples) and not any(a == "12" for _, a, *_ in triples)
    plan = rules(df.withColumnRenamed("text", "content"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_documents_are_ingested_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tiers, "FAN", 2)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    schema = "event_id string, user_id string, doc_id long, source_file string, ts timestamp"
    event = lambda i, later=0: (f"up-{i}", "uv"[i % 2], i, f"f{i}", at(i + later))
    slices = [[event(1), event(2), event(2)], [event(1, 7200), event(3), event(9)], [event(4), event(2, 90_000_000), event(5), event(5, 5), event(6), (None, "u", 1, "f", at(9))]]

    def start(stream, checkpoint, _):
        ingest_documents(stream, docs, str(tmp_path / "out"), checkpoint, rules).trigger(availableNow=True).start().awaitTermination(300)

    run_in_turn(spark, tmp_path, schema, slices, start)
    ingestion = Ingestion(spark, str(tmp_path / "out"))
    entities, relations = ingestion.graph()
    found = document_triples(docs, rules)
    once = spark.createDataFrame([event(i) for i in range(1, 7)], schema)
    rows = found.join(once, "doc_id").withColumn("seq", F.struct("ts", "doc_id", "seq"))
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    e = ("user_id", "name", "type")
    r = ("user_id", "source", "target", "type", "weight", "source_files")
    assert key(entities, *e) == key(g.upsert_entities(rows), *e) and key(relations, *r) == key(g.upsert_relations(rows), *r)
    status = {x.doc_id: x.status for x in ingestion.documents.read(3).collect()}
    assert status == {"1": "Completed", "2": "Failed", "3": "Failed", "4": "Failed", "5": "Completed", "6": "Completed", "9": "Failed"}
