from pyspark.sql import functions as F

from lattica.operators import graph as g

TRIPLES = "user_id string, source_file string, seq long, source string, source_type string, relation string, target string, target_type string"
ROWS = [
    ("u", "a", 1, "Ann", "Entity", "KNOWS", "Bob", "Person"),
    ("u", "a", 2, "Ann", "Person", "KNOWS", "Bob", "Entity"),
    ("u", "b", 3, "ann", "Person", "KNOWS", "Bob", "Person"),
    ("u", "b", 4, "Bob", "Person", "LIKES", "Ann", "Person"),
    ("u", "b", 5, "Eve", "Entity", "OWNS", "Car", "Entity"),
    ("v", "a", 6, "Ann", "Robot", "KNOWS", "Zed", "Entity"),
]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def graph(spark):
    t = spark.createDataFrame(ROWS, TRIPLES)
    return g.upsert_entities(t), g.upsert_relations(t)


def test_upsert(spark):
    e, r = graph(spark)
    assert ("u", "Ann", "Person") in rows(e, "user_id", "name", "type") and ("v", "Zed", "Entity") in rows(e, "user_id", "name", "type")
    got = {(x.user_id, x.source, x.target, x.type): (x.weight, x.source_files) for x in r.collect()}
    assert got["u", "Ann", "Bob", "KNOWS"] == (2, ["a"]) and got["u", "ann", "Bob", "KNOWS"] == (1, ["b"])
    assert g.check_unique(e, ["user_id", "name"]).count() == 0


def test_upsert_in_two_steps_is_upsert_at_once(spark):
    t = spark.createDataFrame(ROWS, TRIPLES)
    first, second = t.where("seq <= 3"), t.where("seq > 3")
    e, r = g.upsert_entities(second, g.upsert_entities(first)), g.upsert_relations(second, g.upsert_relations(first))
    every = graph(spark)
    assert rows(e, "user_id", "name", "type") == rows(every[0], "user_id", "name", "type")
    assert rows(r, *g.EDGE, "weight", "source_files") == rows(every[1], *g.EDGE, "weight", "source_files")
    old = spark.createDataFrame([("u", "Ann", None)], "user_id string, name string, type string")
    assert ("u", "Ann", None) in rows(g.upsert_entities(t, old), "user_id", "name", "type")


def test_legacy_files(spark):
    df = spark.createDataFrame([("a", None), (None, ["b"]), (None, None)], "source_file string, source_files array<string>")
    assert sorted(map(str, (r.source_files for r in g.normalise_legacy(df).collect()))) == ["['a']", "['b']", "[]"]


def test_degree_and_search(spark):
    e, r = graph(spark)
    e = e.unionByName(spark.createDataFrame([("u", "Lone", None)], "user_id string, name string, type string"))
    assert {x.name: x.degree for x in g.degree(e, r).where("user_id = 'u'").collect()} == {"Ann": 2, "ann": 1, "Bob": 3, "Eve": 1, "Car": 1, "Lone": 0}
    asked = spark.createDataFrame([(1, "u", " AN "), (2, "u", "  "), (3, "v", "ann"), (4, "u", "lone")], "req_id int, user_id string, q string")
    assert rows(g.search_entities(asked, e, r), "req_id", "name", "rank") == [(1, "Ann", 1), (1, "ann", 2), (3, "Ann", 1), (4, "Lone", 1)]
    assert {x.type: x.n for x in g.type_distribution(e).where("user_id = 'u'").collect()} == {"Person": 3, "Entity": 3}


def test_dedup_is_idempotent(spark):
    e, r = graph(spark)
    mapping, e2, r2 = g.dedup_entities(e, r)
    assert rows(mapping, "user_id", "name", "canonical") == [("u", "ann", "Ann")]
    assert rows(g.dedup_summary(mapping), "user_id", "groups", "deleted") == [("u", 1, 1)]
    got = {tuple(x[c] for c in g.EDGE): (x.weight, x.source_files) for x in r2.collect()}
    assert got["u", "Ann", "Bob", "KNOWS"] == (3, ["a", "b"])
    again = g.dedup_entities(e2, r2)
    assert again[0].count() == 0 and rows(again[2], *g.EDGE, "weight") == rows(r2, *g.EDGE, "weight")


def test_delete_document(spark):
    e, r = graph(spark)
    files = spark.createDataFrame([("u", "b")], "user_id string, file string")
    e2, r2 = g.delete_documents(e, r, files)
    assert rows(r2, "user_id", "source", "target") == [("u", "Ann", "Bob"), ("v", "Ann", "Zed")]
    assert g.orphans(e2, r2).count() == 0 and "Eve" not in [x.name for x in e2.collect()]
    shared = spark.createDataFrame([("u", "x", "y", "T", 2, ["a", "b"])], "user_id string, source string, target string, type string, weight long, source_files array<string>")
    assert g.delete_documents(e, shared, files)[1].count() == 0
    assert rows(g.delete_documents(e, shared, files, shrink=True)[1], "source_files") == [(["a"],)]


def test_detail_and_expand(spark):
    e, r = graph(spark)
    asked = spark.createDataFrame([(1, "u", "ANN"), (2, "u", "nobody")], "req_id int, user_id string, name string")
    head, rels, files = g.node_detail(asked, e, r)
    assert rows(head, "req_id", "name", "type", "degree") == [(1, "Ann", "Person", 2), (1, "ann", "Person", 1), (2, None, None, 0)]
    assert ("KNOWS", "Bob", True) in rows(rels, "rel_type", "other", "is_outgoing") and ("LIKES", "Bob", False) in rows(rels, "rel_type", "other", "is_outgoing")
    assert rows(files, "req_id", "file") == [(1, "a"), (1, "b")]
    near = g.expand_node(asked.withColumn("name", F.lit("Bob")), e, r, k=2)
    assert near.where("req_id = 1").count() == 2 and near.select("other_degree").where("other_degree IS NULL").count() == 0


def test_filters(spark):
    e, r = graph(spark)
    assert g.doc_filter(r, F.array(F.lit("a"))).count() == 2 and g.doc_filter(r, F.array().cast("array<string>")).count() == r.count()
    seen, links = g.hide_types(e, r, ["Entity"])
    assert "Car" not in [x.name for x in seen.collect()] and links.where("target = 'Car'").count() == 0
    full = g.full_graph(r, k=2)
    assert {(x.user_id, x.truncated) for x in full.collect()} == {("u", True), ("v", False)}
    merged = g.merge_graphs(e.withColumn("type", F.lit("old")), e, ["user_id", "name"])
    assert {x.type for x in merged.collect()} == {"old"} and merged.count() == e.count()
    told = e.select("user_id", "name", F.lit("Event").alias("proposed")).where("name = 'Car'")
    typed = g.apply_types(e, told, ["Event", "Entity"])
    assert rows(typed.where("updated"), "name", "type") == [("Car", "Event")]
    have = e.withColumn("embedding", F.when(F.col("name") == "Ann", F.array(F.lit(1.0))))
    assert "Ann" not in [x.name for x in g.needs_embedding(e.where("user_id = 'u'").select("user_id", "name"), have).collect()]
