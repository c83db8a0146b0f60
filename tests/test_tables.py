import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lattica.functions import hooks
from lattica.operators import retrieve as rt
from lattica.operators import tables as tb
from lattica.operators import vectors as vc
from lattica.sources import files as sf
from lattica.streaming import jobs, tiers

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def brute_admit(events, limit, seconds):
    last, out = {}, {}
    for user, event, ts in sorted(events, key=lambda e: (e[2], e[1])):
        recent = [x for x in last.get(user, []) if x > ts - seconds]
        out[event] = len(recent) < limit
        last[user] = recent + [ts] * out[event]
    return out


EVENTS = [(1, 1, 0), (1, 2, 10), (1, 3, 20), (1, 4, 101), (1, 5, 105), (1, 6, 111), (2, 7, 5), (1, 8, 300), (1, 9, 300), (1, 10, 300), (2, 11, 6), (2, 12, 7)]


def test_admission(spark):
    df = spark.createDataFrame([(u, e, at(s)) for u, e, s in EVENTS], "user_id long, event_id long, ts timestamp")
    for limit in (1, 2, 3):
        assert {r.event_id: r.admitted for r in tb.admit(df, limit, 100).collect()} == brute_admit(EVENTS, limit, 100)
    got = {r.event_id: r.n_recent for r in tb.sliding_rate(df, 2, "90 seconds").collect()}
    assert got[3] == 3 and got[4] == 2 and got[10] == 3 and got[7] == 1


def test_ingest_stream_equals_one_batch(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id string, source_file string, seq long, source string, source_type string, relation string, target string, target_type string"
    rows = [(i, at(i), "u", f"f{i % 2}", i, f"S{i % 3}", "Entity", "R", f"T{i % 4}", "Thing") for i in range(12)]
    for k in range(3):
        part = rows[4 * k : 4 * k + 4] + rows[:1]  # the first event comes again
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    e, r = jobs.streamed_graph(spark, str(tmp_path / "out"))
    from lattica.operators import graph as g

    batch = spark.createDataFrame(rows, schema)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(e) == key(g.upsert_entities(batch)) and key(r) == key(g.upsert_relations(batch))


def test_ingest_stream_knows_ids_without_state(spark, tmp_path, monkeypatch):
    """Repeats within the lateness count once, however batches are folded; events behind the watermark are left out; executors hold no ids."""
    monkeypatch.setattr(tiers, "FAN", 2)
    schema = "event_id string, ts timestamp, user_id string, source_file string, seq long, source string, source_type string, relation string, target string, target_type string"
    row = lambda i, s: (i, None if s is None else at(s), "u", "f", 1, f"S{i}", "Entity", "R", "T", "Thing")
    slices = [
        [row("a", 0), row("a", 5), row("b", 10), row(None, 1), row("n", None)],
        [row("a", 50), row("b", 10), row("c", 90), row(None, 2), row("n", None)],
        [row("b", 95), row("d", 95), row("e", 31), row("late", 30), row("c", 89)],
        [row("d", 200), row("c", 120), row("f", 300)],
        [row("d", 290), row("f", 241), row("late", 240), row("g", 305)],
    ]
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "c"), "1 minute").trigger(availableNow=True).start().awaitTermination(120)
    _, r = jobs.streamed_graph(spark, str(tmp_path / "out"))
    # d comes again two minutes after it was last kept, so it counts once more; the ids that it could repeat are gone
    assert {x.source: x.weight for x in r.collect()} == {"Sa": 1, "Sb": 1, "SNone": 1, "Sn": 1, "Sc": 1, "Sd": 2, "Se": 1, "Sf": 1, "Sg": 1}
    assert not (tmp_path / "c/state").exists()


def test_status_feed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "FOLDED", 1)
    schema = "user_id string, document_id string, version long, kind string, status string"
    parts = [[("u", "a", 1, "INSERT", "Processing"), ("u", "b", 1, "INSERT", "Processing")], [("u", "a", 3, "UPDATE", "Completed"), ("u", "a", 2, "UPDATE", "Failed")], [("u", "a", 1, "INSERT", "Processing")]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        jobs.document_status_feed(stream, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = jobs.document_status(spark, str(tmp_path / "out"))
    assert {r.document_id: r.status for r in got.collect()} == {"a": "Completed", "b": "Processing"}


def test_vectors(spark):
    rows = [("u", "a", [1.0, 0.0]), ("u", "b", [0.0, 2.0]), ("v", "c", [3.0, 0.1]), ("u", "z", [0.0, 0.0]), ("u", "n", None)]
    e = spark.createDataFrame(rows, "user_id string, name string, embedding array<float>")
    q = spark.createDataFrame([(1, "u", [1.0, 0.05])], "query_id int, user_id string, embedding array<float>")
    assert [r.name for r in vc.vector_topk(q, e, 2).collect()] == ["a"]
    assert sorted(r.name for r in vc.vector_topk(q, e, 2, prefilter=True).collect()) == ["a", "b"]
    pair = spark.createDataFrame([([1.0, 1.0], [1.0, 0.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = [r.c for r in pair.select(vc.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None and got[2] is None


def test_blocks_of_queries(spark, monkeypatch):
    rows = [("u", f"n{i}", [float(i), 1.0]) for i in range(30)]
    e = spark.createDataFrame(rows, "user_id string, name string, embedding array<float>")
    q = e.selectExpr("name AS query_id", "user_id", "embedding")
    one = sorted(map(tuple, vc.vector_topk(q, e, 3).collect()))
    monkeypatch.setattr(vc, "BLOCK", 5)
    assert sorted(map(tuple, vc.vector_topk(q, e, 3).collect())) == one and len(one) == 90


def test_cache(spark):
    cache = spark.createDataFrame([("u", "Why?", [1.0, 0.0], "old", 1), ("u", "WHY?", [1.0, 0.01], "new", 2), ("v", "Why?", [1.0, 0.0], "other", 3)], "user_id string, question string, embedding array<float>, answer string, created_at int")
    asked = spark.createDataFrame([(1, "u", "why?", [1.0, 0.0], False), (2, "u", "what", [0.0, 1.0], False), (3, "u", "why?", [1.0, 0.0], True)], "question_id int, user_id string, question string, embedding array<float>, has_history boolean")
    assert [(r.question_id, r.answer) for r in vc.cache_lookup_semantic(asked, cache).collect()] == [(1, "old")]
    assert {(r.question_id, r.answer) for r in vc.cache_lookup_exact(asked, cache).collect()} == {(1, "new"), (3, "new")}
    grown = vc.cache_append(cache, asked.withColumn("answer", F.lit("x <suggestions>[]</suggestions> ")).withColumn("created_at", F.lit(9)))
    assert grown.count() == 5 and {r.answer for r in grown.where("created_at = 9").collect()} == {"x"}


def test_nearest_against_brute_force(spark, monkeypatch):
    import math
    import random

    r = random.Random(4)
    vector = lambda: r.choice([None, [0.0, 0.0], [1.0, 2.0, 3.0]]) if r.random() < 0.1 else [float(r.randrange(-2, 3)), float(r.randrange(-2, 3))]
    rows = [(r.choice("uv"), f"n{i:03}", vector()) for i in range(120)]
    asked = [(i, r.choice("uvw"), vector()) for i in range(25)]
    e = spark.createDataFrame(rows, "user_id string, name string, embedding array<float>").repartition(3)
    q = spark.createDataFrame(asked, "query_id int, user_id string, embedding array<float>")

    def brute(k, same):
        out = []
        for i, u, a in asked:
            near = []
            for v, n, b in rows:
                if a and b and len(a) == len(b) and any(a) and any(b) and (not same or u == v):
                    near.append((-round(sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b), 9), v, n))
            out += [(i, v, n) for _, v, n in sorted(near)[:k] if u == v]
        return sorted(out)

    for block in (4096, 7):
        monkeypatch.setattr(vc, "BLOCK", block)
        for same in (False, True):
            assert sorted((x.query_id, x.user_id, x["name"]) for x in vc.vector_topk(q, e, 4, prefilter=same).collect()) == brute(4, same)
    assert vc.vector_topk(q.limit(0), e, 4).count() == 0 == vc.vector_topk(q, e.limit(0), 4).count()


def test_vectors_of_terms(spark):
    e = spark.createDataFrame([("u", "Ann", [1.0, 0.0]), ("u", "Bob", [0.0, 1.0]), ("v", "Eve", [1.0, 0.1]), ("u", "Cy", None)], "user_id string, name string, embedding array<float>")
    r = spark.createDataFrame([("u", "Ann", "Cy", "R", 1, ["f"]), ("u", "Bob", "Cy", "R", 2, ["f"]), ("v", "Eve", "Cy", "R", 1, ["f"])], "user_id string, source string, target string, type string, weight long, source_files array<string>")
    q = spark.createDataFrame([(1, "u", ["q1", "q2", "q3"], None, [[1.0, 0.0], None, [0.1, 1.0]]), (2, "u", ["Bob"], None, None)], "question_id int, user_id string, entities array<string>, docs array<string>, embeddings array<array<float>>")
    rows = rt.retrieve(q, e, r, k_vector=1)
    got = sorted((x.question_id, x.step, x.term, x["rank"], x.start, x.m, x.k) for x in rows.collect())
    assert got == [(1, "C", 0, 1, "Ann", "Cy", "Bob"), (1, "C", 2, 1, "Bob", "Cy", "Ann"), (2, "A", None, 1, "Bob", "Cy", "Ann")]
    assert {(x.question_id, x.id) for x in rt.matched(rows).collect()} == {(2, "Bob")}


def test_retrieval_gate(spark):
    e = spark.createDataFrame([("u", n, "T") for n in ("Ann", "Anna", "Bob", "Cy")], "user_id string, name string, type string")
    edges = [("Ann", "Bob", ["f1"]), ("Bob", "Cy", ["f2"]), ("Anna", "Cy", ["f1"]), ("Ann", "Ann", ["f1"])]
    r = spark.createDataFrame([("u", s, t, "R", 1, f) for s, t, f in edges], "user_id string, source string, target string, type string, weight long, source_files array<string>")
    q = spark.createDataFrame([(1, "u", ["ann"], None), (2, "u", ["an"], []), (3, "u", ["ann"], ["f2"]), (4, "u", ["zzz"], None)], "question_id int, user_id string, entities array<string>, docs array<string>")
    rows = rt.retrieve(q, e, r)
    got = {(x.question_id, x.step, x.start, x.m, x.k) for x in rows.collect()}
    assert (1, "A", "Ann", "Bob", "Cy") in got and all(x[1] == "A" for x in got if x[0] == 1)
    assert {x[1:3] for x in got if x[0] == 2} == {("B", "Ann"), ("B", "Anna")}
    assert not [x for x in got if x[0] in (3, 4)]
    text = {x.question_id: x.context for x in rt.build_context(rows).collect()}
    assert text[1].startswith("## Direct Facts\n[Source: f1] Ann --[R]--> ") and "\n\n## Related Context\n" in text[1] and text[1].endswith("\n")
    told = {x.question_id: (x.n_nodes, x.refusal) for x in rt.answerability(q, rows).collect()}
    assert told[1] == (3, None) and told[4] == (0, rt.REFUSAL)


def test_hooks(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(7)], "id int, name string").coalesce(1)

    def embed(texts):
        if "n4" in texts:
            raise ValueError
        return [[float(t[1:])] for t in texts]

    got = {r.name: r.embedding for r in hooks.embed_in_batches(df, embed, size=2).collect()}
    assert got == {**{f"n{i}": [float(i)] for i in range(7)}, "n4": None, "n5": None}
    assert {r.embedding for r in hooks.embed_in_batches(df, None).collect()} == {None}
    named = df.withColumnRenamed("name", "text")
    assert {r.doc_class for r in hooks.classify(named, lambda s: " Legal " if s == "n1" else 1 / 0).collect()} == {"legal", "general"}
    chunks = df.withColumnRenamed("name", "content")
    assert sorted(str(r.raw) for r in hooks.extract(chunks, lambda t: json.dumps({"t": t}) if t == "n1" else 1 / 0).collect())[-1] == '{"t": "n1"}'
    typed = {r.name: r.proposed for r in hooks.propose_types(df.select("name"), lambda names: {"n2": "Person"}).collect()}
    assert typed["n2"] == "Person" and typed["n1"] is None


def test_extraction_in_order(spark):
    rows = [(d, c, f"{d}{c}", "T") for d in ("x", "y") for c in range(5)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_idx int, content string, label string").repartition(3)

    def extractor(text, template, registry):
        if text == "x2":
            raise ValueError
        names = [f"name {text}", "SHARED", "Shared", "7"]
        return "```json" + json.dumps({"entities": [{"name": n, "type": template["label"]} for n in names], "seen": [e["name"] for e in registry]}) + "```"

    got = {r.content: r.raw for r in hooks.extract_in_order(chunks, extractor, ["label"], most=2).collect()}
    seen = {k: json.loads(v.strip("`")[4:])["seen"] for k, v in got.items() if v}
    assert got["x2"] is None and seen["x0"] == seen["y0"] == [] and seen["x1"] == ["name x0", "SHARED"] and seen["x3"] == ["SHARED", "name x1"] and seen["y4"] == ["name y2", "name y3"]


def test_files(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("name,father,mother\nAnn,Bob,Eve\nBob,,\n")
    (tmp_path / "b.exe").write_text("x")
    good, bad = sf.read_landing(spark, str(tmp_path))
    assert [r.ext for r in good.collect()] == ["csv"] and [r.ext for r in bad.collect()] == ["exe"]
    got = sorted((r.source, r.relation, r.target) for r in sf.csv_to_triples(spark, str(tmp_path / "a.CSV")).collect())
    assert got == [("Ann", "child of", "Bob"), ("Ann", "child of", "Eve")]
    (tmp_path / "e.csv").write_text('Person A,Relationship,Person B,City,Country\nAnn,LIVES_IN,"Rome, Italy",Rome,Italy\nAnn,MARRIED_TO,Bob,Rome,Italy\n')
    assert sorted((r.relation, r.target, r.target_type) for r in sf.read_edge_list(spark, str(tmp_path / "e.csv")).collect()) == [("LIVES_IN", "Rome, Italy", "Location"), ("MARRIED_TO", "Bob", "Person")]
    assert sf.read_text_documents(spark, str(tmp_path / "b.exe")).first().text == "x"
    e = spark.createDataFrame([("u", "A", "T"), ("v", "B", "T")], "user_id string, name string, type string")
    r = spark.createDataFrame([("u", "A", "A2", "R", 1, ["f"])], "user_id string, source string, target string, type string, weight long, source_files array<string>")
    sf.write_graph(e, r, str(tmp_path / "g"))
    sf.write_graph(e.where("user_id = 'u'").withColumn("type", F.lit("N")), r, str(tmp_path / "g"))
    back = sf.read_graph(spark, str(tmp_path / "g"))
    assert {(x.user_id, x.type) for x in back[0].collect()} == {("u", "N"), ("v", "T")} and back[1].count() == 1
    shown = sf.view_graph(e.withColumnRenamed("name", "id"), r.select("user_id", "source", "target"), ["user_id"])
    assert json.loads({x.user_id: x.graph for x in shown.collect()}["u"])["links"] == [{"source": "A", "target": "A2"}]
    sf.export_graph(e, r, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x/nodes")).count() == 2


def test_containing_against_brute_force(spark):
    import random

    from lattica.operators.search import containing

    r = random.Random(11)
    word = lambda most: "".join(r.choice("aab é😀") for _ in range(r.randrange(most)))
    needles = [(i, r.choice("uv"), word(6)) for i in range(60)] + [(90, "u", None), (91, "u", "aab"), (91, "u", "aab"), (92, "w", "a")]
    texts = [(r.choice("uv"), j, word(14)) for j in range(150)] + [("u", 900, None), ("u", 901, "xxaabxx"), ("u", 901, "xxaabxx"), (None, 902, "a")]
    asked = spark.createDataFrame(needles, "req_id int, user_id string, q string")
    held = spark.createDataFrame(texts, "user_id string, n int, low string")
    want = sorted((i, n) for i, u, q in needles for v, n, t in texts if q and t is not None and u == v and q in t)
    assert want and sorted((x.req_id, x.n) for x in containing(asked, held, "q", "low").collect()) == want
    assert containing(asked.limit(0), held, "q", "low").count() == 0 == containing(asked, held.limit(0), "q", "low").count()
