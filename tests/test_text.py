import json
import random
import re

from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.functions.baseline import answer
from lattica.operators import ingest as ig


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_normalise(spark):
    nbsp, bom, zero = " ", "﻿", "​"
    assert one(spark, f"{bom}{nbsp} A\t\n B{zero}C ‘x’ “y” a–b—c ", tx.normalise_entity_name) == "A BC 'x' \"y\" a-b-c"
    assert one(spark, None, tx.normalise_entity_name) is None


def test_chunks(spark):
    for n, want in ((0, 1), (1500, 1), (1501, 2), (2800, 2), (2801, 3), (20_000, 16)):
        text = "".join(chr(97 + i % 26) for i in range(n))
        got = one(spark, text, tx.chunks)
        assert len(got) == want and got[0] == text[:1500] and (n == 0 or got[-1][-1] == text[-1])
    assert one(spark, "x" * 20_001, tx.cap_text).truncated


def test_extraction(spark):
    raw = 'Sure:\n```JSON\n{"entities": [{"name": " Ann ", "type": " "}, {"name": "7", "type": "N"}, {"name": "X", "type": "N"}], "relations": [{"source": "Ann", "relation": "works  at", "target": "ACME"}, {"source": "Ann", "relation": "is", "target": "Ann"}, {"source": "12", "relation": "is", "target": "Ann"}]}\n``` bye'
    got = one(spark, raw, tx.parse_extraction)
    assert len(got.entities) == 3 and len(got.relations) == 3
    clean = spark.createDataFrame([(raw,)], "raw string")
    entities, relations = ig.extracted(clean, [])
    assert [(e.name, e.type) for e in entities.collect()] == [("Ann", "Entity")]
    assert [(r.source, r.relation, r.target) for r in relations.collect()] == [("Ann", "WORKS_AT", "ACME")]
    for bad in (None, "", "no json", '{"entities": ['):
        got = one(spark, bad, tx.parse_extraction)
        assert got.entities == [] and got.relations == []


def test_answers(spark):
    text = 'Hi <suggestions>["a", "b"]</suggestions> there <suggestions>x</suggestions> '
    assert one(spark, text, tx.extract_suggestions) == ["a", "b"] and one(spark, "x <suggestions>[</suggestions>", tx.extract_suggestions) is None
    assert one(spark, text, tx.clean_answer) == "Hi  there <suggestions>x</suggestions>"
    assert one(spark, " Legal ", tx.validate_class) == "legal" and one(spark, "Resume/CV", tx.validate_class) == "resume_cv" and one(spark, None, tx.validate_class) == "general"
    ask = lambda raw: one(spark, raw, lambda c: tx.parse_entity_list(c, F.lit("q")))
    assert ask('x ["a", "b"] y') == ["a", "b"] and ask("[]") == ask("x") == ask(None) == ask("[1") == ["q"]
    assert one(spark, ["Unknown", "", "f"], tx.source_label, "array<string>") == "[Source: f] " and one(spark, [], tx.source_label, "array<string>") == ""


def test_table_to_triples(spark):
    rows = [("Ann Lee", "Bob; ; Cy|Ann Lee", "Paris", "x"), (" ", "Bob", "Rome", "x"), ("Dee", None, "", "x")]
    df = spark.createDataFrame(rows, "`Full Name` string, Father string, `Birth City` string, note string")
    got = sorted((r.source, r.relation, r.target, r.target_type) for r in ig.table_to_triples(df, df.columns, []).collect())
    assert got == [("Ann Lee", "born in", "Paris", "Location"), ("Ann Lee", "child of", "Bob", "Person"), ("Ann Lee", "child of", "Cy", "Person")]
    assert ig.relation_of("person_b") == ("parent of", "Person", "Person") and ig.relation_of("ethnicity")[0] == "born in" and ig.relation_of("age") is None
    assert ig.table_to_triples(df.select("note"), ["note"], []).count() == 0


TRIPLES = "doc_id int, seq int, source string, relation string, target string"


def test_aliases(spark):
    rows = [(1, 1, "Lee", "IS", "Ann Lee"), (1, 2, "Ann Lee", "IS", "Dr Ann Lee"), (1, 3, "Dr Ann Lee", "AT", "X"), (1, 4, "Lee", "AT", "X"), (1, 5, "lee", "AT", "Y"), (2, 1, "A", "R", "B"), (2, 2, "A", "R", "B")]
    t = spark.createDataFrame(rows, TRIPLES)
    got = {(r.doc_id, r.name): r.full for r in ig.alias_candidates(t).collect()}
    assert got == {(1, "Lee"): "Dr Ann Lee", (1, "lee"): "Dr Ann Lee", (1, "Ann Lee"): "Dr Ann Lee"}
    kept = sorted((r.doc_id, r.source, r.target) for r in ig.alias_resolution(t).collect())
    assert kept == [(1, "Dr Ann Lee", "X"), (1, "Dr Ann Lee", "Y"), (2, "A", "B"), (2, "A", "B")]
    assert ig.alias_resolution(t, always=True).where("doc_id = 2").count() == 1
    again = ig.alias_resolution(ig.alias_resolution(t))
    assert sorted((r.doc_id, r.source, r.target) for r in again.collect()) == kept


def test_case_fold(spark):
    t = spark.createDataFrame([(1, 1, "ann", "R", "Bob"), (1, 2, "BOB", "R", "Ann"), (1, 3, "ANN", "R", "ann")], TRIPLES)
    assert sorted((r.source, r.target) for r in ig.case_fold(t).collect()) == [("Bob", "ann"), ("ann", "Bob")]


def test_types_come_from_the_registry(spark):
    entities = spark.createDataFrame([(1, 0, 0, "Ann", "Old"), (1, 0, 1, "Cy", "First"), (1, 1, 0, "ann", "New"), (1, 2, 0, "Zed", "Late")], "doc_id int, chunk_idx int, pos int, name string, type string")
    t = spark.createDataFrame([(1, 1, "Ann", "", "Cy", " "), (1, 2, "ANN", None, "Q", "Given"), (1, 0, "Zed", None, "Cy", None)], "doc_id int, chunk_idx int, source string, source_type string, target string, target_type string")
    got = {r.chunk_idx: (r.source_type, r.target_type) for r in ig.resolve_types(t, entities).collect()}
    assert got == {1: ("New", "First"), 2: ("Old", "Given"), 0: ("Entity", "First")}
    small = {r.chunk_idx: (r.source_type, r.target_type) for r in ig.resolve_types(t, entities, most=1).collect()}
    assert small[1] == ("New", "First") and small[2] == ("Entity", "Given")


def test_rules_of_the_baseline_are_tried_once(spark):
    """The places of a rule are those of one plain pattern read from the left, found in one pass over a sentence that has a verb."""
    word = "[A-Za-zÀ-ÿ'-]+"
    phrase = f"{word}(?: {word}){{0,2}}"
    verbs = ["is", "was", "with", "a.b"]
    rule = re.compile(f"({phrase}) ({'|'.join(map(re.escape, verbs))}) ({phrase})")
    r = random.Random(6)
    words = ["is", "was", "with", "a.b", "axb", "x", "Éa", "d'or", "so-so", "7", "a1b", "is7", "7is", "Tom", "|", "", "this", "é,è"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(14))) for _ in range(600)]
    texts += ["A | is | B", "A is B | C", "one two three four is five six seven eight is nine", "is is is is is", "x1y is z", "9a is b"]
    # a full stop ends a sentence, so the verb with one is never found
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", answer(F.col("t"), verbs).alias("raw"))
    for x in rows.collect():
        want = []
        parts = [p.strip(" ") for p in re.split(r"[.!?\r\n]+", texts[x.i])]
        want += [tuple(c.strip(" ") for c in p.split("|")) for p in parts if p and p.count("|") == 2]
        want += [m for p in parts if p and p.count("|") != 2 for m in rule.findall(p)]
        assert [(f["source"], f["relation"], f["target"]) for f in json.loads(x.raw)["relations"]] == want, texts[x.i]
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 2
