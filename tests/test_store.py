import random

import pytest
from lattica.operators import graph as g
from lattica.sources.store import GraphStore

T = "user_id string, source_file string, seq long, source string, source_type string, relation string, target string, target_type string"


def some(r, n, first=0):
    name = lambda: r.choice(["Ann", "ann", "ANN", "Bob", "bob", "Rome", "rome", "Éva", "éva", *(f"n{i}" for i in range(20))])
    return [(r.choice("uv"), r.choice(["f", "g"]), first + i, name(), r.choice(["Entity", "Person"]), r.choice("RS"), name(), "Entity") for i in range(n)]


def key(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in x) for x in df.collect()), key=str)


def test_upserts_in_turn_are_one_upsert(spark, tmp_path):
    r = random.Random(1)
    store, whole = GraphStore(spark, str(tmp_path / "graph"), 8), []
    for k in range(3):
        rows = some(r, 30, 100 * k)
        store.upsert(spark.createDataFrame(rows, T))
        whole += rows
    df = spark.createDataFrame(whole, T)
    assert key(store.entities) == key(g.upsert_entities(df)) and key(store.relations) == key(g.upsert_relations(df))
    before = key(store.relations)
    store.upsert(df.limit(0))
    assert key(store.relations) == before
    assert GraphStore(spark, str(tmp_path / "none")).entities.count() == 0
    with pytest.raises(ValueError):
        store.upsert(df, match="nearly")


def test_case_insensitive_match(spark, tmp_path):
    r = random.Random(2)
    store = GraphStore(spark, str(tmp_path / "graph"), 8)
    first = [x for x in some(r, 40) if "ANN" not in (x[3], x[6])]
    second = [*some(r, 40, 1000), ("w", "f", 5000, "NEW", "Entity", "R", "new", "Entity"), ("w", "f", 5001, "New", "Entity", "R", "x", "Entity"), (None, "f", 1, "Ann", "Entity", "R", "Bob", "Entity"), ("u", "f", 1, None, "Entity", "R", "Bob", "Entity")]
    store.upsert(spark.createDataFrame(first, T)).upsert(spark.createDataFrame(second, T), match="case_insensitive")
    held = {(u, n) for u, _, _, s, _, _, t, _ in first for n in (s, t)}
    come = {}
    for u, _, _, s, _, _, t, _ in second:
        for n in (s, t):
            if u and s and t:
                come.setdefault((u, n.lower()), n)

    def spelled(u, n):
        same = sorted(x for v, x in held if v == u and x.lower() == n.lower())
        return n if n in same else same[0] if same else come[u, n.lower()]

    moved = [(u, f, q, spelled(u, s), a, k, spelled(u, t), b) for u, f, q, s, a, k, t, b in second if u and s and t]
    df = spark.createDataFrame(first + moved, T)
    assert key(store.entities) == key(g.upsert_entities(df)) and key(store.relations) == key(g.upsert_relations(df))
    assert {n for u, n in {(x.user_id, x["name"]) for x in store.entities.collect()} if u == "w"} == {"NEW", "x"}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    r = random.Random(3)
    store = GraphStore(spark, str(tmp_path / "graph"), 32)
    store.upsert(spark.createDataFrame(some(r, 200), T))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "graph").glob("*/bucket=*/*.parquet")}
    before = files()
    store.upsert(spark.createDataFrame([("u", "f", 9999, "ANN", "Entity", "R", "ROME", "Entity")], T), match="case_insensitive")
    after = files()
    folder = lambda some_files: {p.rsplit("/", 1)[0] for p in some_files}
    changed = folder(set(before) ^ set(after))
    assert 2 <= len(changed) <= 3 and len(folder(before)) > 20
    assert all(after[p] == t for p, t in before.items() if p.rsplit("/", 1)[0] not in changed)
