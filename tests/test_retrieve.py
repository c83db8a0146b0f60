import random

from lattica.operators import retrieve as rt
from lattica.operators.graph import both_ways
from lattica.sources import shared
from pyspark.sql import functions as F

R = "user_id string, source string, target string, type string, weight long, source_files array<string>"


def brute(starts, relations, k):
    """All rows of two hops of each question in order, the first k."""
    sym = [(u, s, t, True, ty, w, f) for u, s, t, ty, w, f in relations] + [(u, t, s, False, ty, w, f) for u, s, t, ty, w, f in relations]
    out = []
    for question in sorted({q for q, *_ in starts}):
        rows = []
        for q, user, docs, start in starts:
            if q != question or not start.strip():
                continue
            fits = lambda files, docs=docs: not docs or any(d in f for f in files for d in docs)
            for u, node, m, fwd, ty, w, files in sym:
                if (u, node) != (user, start) or not fits(files) or not m.strip():
                    continue
                second = [(0, k2, t2, f2) for u2, n2, k2, f2, t2, _, fi2 in sym if (u2, n2) == (user, m) and k2 not in (start, m) and fits(fi2)]
                rows += [(-w, start, m, ty, fwd, *x) for x in second or [(1, None, None, None)]]
        rows.sort(key=lambda x: tuple((v is None, v if v is not None else 0) for v in x))
        out += [(question, rank, *r[1:5], *r[6:]) for rank, r in enumerate(rows[:k], 1)]
    return out


def test_ranked_second_hops_against_brute_force(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    names = [f"n{i}" for i in range(12)] + [" "]
    edges = {(r.choice("uv"), r.choice(names), r.choice(names), r.choice("RST")) for _ in range(120)}
    edges |= {("u", "hub", f"leaf{i:03}", "R") for i in range(150)} | {("u", f"n{i}", "hub", t) for i in range(6) for t in "RSTUV"} | {("u", "hub", "hub", "R")}
    relations = [(*e, r.choice([1, 1, 2, 5]), r.sample(["doc_a", "doc_b", "other"], r.randint(0, 2))) for e in sorted(edges)]
    starts = [(q, r.choice("uv"), r.choice([None, [], ["doc_a"], ["doc_b", "a"], ["a", "doc_b"]]), None) for q in range(14)]
    starts = [(q, u, d, s) for q, u, d, _ in starts for s in r.sample([*names, "hub"], 3)]
    df = spark.createDataFrame(starts, "question_id int, user_id string, docs array<string>, start string")
    sym = both_ways(spark.createDataFrame(relations, R))
    kept = []
    store = shared.stored
    monkeypatch.setattr(rt, "stored", lambda d, name="round": kept.append(store(d, name)) or kept[-1])
    for k in (1, 7, 50):
        got = rt.hops(df, sym, k).select("question_id", "rank", "start", "m", "type1", "forward1", "k", "type2", "forward2")
        assert sorted(map(tuple, got.collect()), key=lambda x: x[:2]) == brute(starts, relations, k)
        # what is wanted of second hops: no more than fills the rows, beside the few relations back to the start
        assert kept[-1].where(F.col("wanted") > k + 12).count() == 0
    assert rt.hops(df.limit(0), sym, 5).count() == 0


def asked(spark):
    r = random.Random(4)
    names = [f"Name {i}" for i in range(20)] + ["Hub"]
    links = {("u", r.choice(names), r.choice(names), r.choice("RS")) for _ in range(60)} | {("u", "Hub", f"leaf {i}", "R") for i in range(40)}
    relations = spark.createDataFrame([(*e, r.choice([1, 2, 3]), r.sample(["doc_a", "doc_b"], r.randint(1, 2))) for e in sorted(links)], R)
    ends = sorted({x for _, s, t, _ in links for x in (s, t)})
    entities = spark.createDataFrame([("u", n, "Entity", [r.random(), r.random()]) for n in ends], "user_id string, name string, type string, embedding array<double>")
    terms = [["hub"], ["NAME 3", "leaf 7"], ["ame 1"], ["the name 4 company", ""], ["nothing"], ["name 2"]]
    rows = [(q, "u", terms[q % len(terms)], r.choice([None, ["doc_a"]]), [[r.random(), r.random()]] if q % 2 else None) for q in range(18)]
    return spark.createDataFrame(rows, "question_id int, user_id string, entities array<string>, docs array<string>, embeddings array<array<double>>"), entities, relations


def test_second_hops_are_looked_for_once_for_all_steps(spark, monkeypatch):
    kept, store = [], shared.stored
    monkeypatch.setattr(rt, "stored", lambda d, name="round": kept.append(name) or store(d, name))
    monkeypatch.setattr(rt, "LIMITS", {"exact": 9, "substring": 5, "vector": 7})
    whole = rt.retrieve(*asked(spark))
    assert kept.count("first-hops") == 3  # of exact names, of the other steps, and those of all steps that are shown
    most = {"A": 9, "B": 5, "C": 7}
    rows = whole.collect()
    assert {x.step for x in rows} == set("ABC") and all(x["rank"] <= most[x.step] for x in rows)
    for key in {(x.question_id, x.step, x.term) for x in rows}:
        own = sorted(x["rank"] for x in rows if (x.question_id, x.step, x.term) == key)
        assert own == list(range(1, len(own) + 1))
    kept.clear()
    bare = rt.retrieve(*asked(spark), degrees=False)
    assert "degrees" not in kept
    assert sorted(map(tuple, rt.build_context(bare).collect())) == sorted(map(tuple, rt.build_context(whole).collect()))


def test_matched_names_need_no_vectors_or_second_hops(spark, monkeypatch):
    monkeypatch.setattr(rt, "LIMITS", {"exact": 9, "substring": 5, "vector": 7})
    want = sorted(map(tuple, rt.matched(rt.retrieve(*asked(spark))).collect()))
    monkeypatch.setattr(rt, "nearest_starts", None)
    monkeypatch.setattr(rt, "_with_second", None)
    assert want and sorted(map(tuple, rt.matched_names(*asked(spark)).collect())) == want
