import random

from lattica.operators import paths as p
from lattica.sources import shared

R = "user_id string, source string, target string, type string, weight long, source_files array<string>"


def relations(spark):
    edges = [("u", "A", "B"), ("u", "C", "B"), ("u", "C", "D"), ("u", "D", "A"), ("u", "D", "E"), ("u", "e", "F"), ("v", "A", "Z"), ("u", "X", "Y")]
    return spark.createDataFrame([(u, s, t, "T", 1, ["f"]) for u, s, t in edges], R)


def test_shortest_path(spark):
    pairs = [(1, "u", "a", "e"), (2, "u", "A", "a"), (3, "u", "A", "Y"), (4, "v", "A", "B"), (5, "u", "nobody", "A"), (6, "u", "B", "D"), (7, "u", "E", "A")]
    df = spark.createDataFrame(pairs, "pair_id int, user_id string, `from` string, `to` string")
    summary, steps = p.shortest_path(df, relations(spark))
    assert {r.pair_id: (r.found, r.length) for r in summary.collect()} == {1: (True, 2), 2: (True, 0), 3: (False, None), 4: (False, None), 5: (False, None), 6: (True, 2), 7: (True, 2)}
    by = {}
    for r in steps.orderBy("pair_id", "step").collect():
        by.setdefault(r.pair_id, []).append(r.node)
    assert by[1] == ["A", "D", "E"] and by[2] == ["A"] and by[6] == ["B", "A", "D"] and by[7] == ["E", "D", "A"]
    assert {r.pair_id: r.found for r in p.shortest_path(df, relations(spark), max_hops=1)[0].collect()}[1] is False


def test_paths_and_links_against_brute_force(spark):
    r = random.Random(6)
    names = ["a", "A", "b", "c", "d", "e", "f", "g", "h", "i", "hub"]
    edges = {(r.choice("uv"), r.choice(names), r.choice(names), r.choice("RST")) for _ in range(34)} | {("u", "hub", f"n{i}", "R") for i in range(30)} | {("u", "n3", "far", "R"), ("u", "far", "end", "S")}
    rows = [(*e, r.choice([1, 2, 3]), ["f"]) for e in sorted(edges)]
    pairs = [(i, r.choice("uv"), r.choice([*names, "FAR", "END"]), r.choice([*names, "end", "none"])) for i in range(40)] + [(99, "u", None, "a")]
    near = {}
    for u, s, t, *_ in rows:
        near.setdefault((u, s), set()).add(t)
        near.setdefault((u, t), set()).add(s)

    def brute(user, start, end, most):
        """The nodes of the shortest path with the smallest names from the end backwards."""
        level = {n: 0 for u, n in near if u == user and start and n.lower() == start.lower()}
        ring = sorted(level)
        for hop in range(1, most + 1):
            ring = sorted({m for n in ring for m in near[user, n]} - set(level))
            level |= dict.fromkeys(ring, hop)
        ends = sorted((level[n], n) for n in level if n.lower() == end.lower())
        if not ends:
            return None
        path = [ends[0][1]]
        while level[path[0]]:
            path.insert(0, min(m for m in near[user, path[0]] if level.get(m) == level[path[0]] - 1))
        return path

    df = spark.createDataFrame(pairs, "pair_id int, user_id string, `from` string, `to` string")
    for most in (4,):
        summary, steps = p.shortest_path(df, spark.createDataFrame(rows, R), max_hops=most)
        want = {i: brute(u, a, b, most) for i, u, a, b in pairs}
        assert {x.pair_id: x.length for x in summary.collect()} == {i: None if w is None else len(w) - 1 for i, w in want.items()}
        found = {}
        for x in steps.orderBy("pair_id", "step").collect():
            found.setdefault(x.pair_id, []).append(x)
        user = {i: u for i, u, _, _ in pairs}
        assert {i: [x.node for x in f] for i, f in found.items()} == {i: w for i, w in want.items() if w}
        for i, f in found.items():
            assert f[0].source is None and f[0].label is None
            for before, x in zip(f, f[1:]):
                links = [(-w, t, s != before.node, s, e) for u, s, e, t, w, _ in rows if u == user[i] and {s, e} == {before.node, x.node}]
                weight, label, _, source, target = min(links)
                assert (x.weight, x.label, x.source, x.target) == (-weight, label, source, target)
    assert p.shortest_path(df.limit(0), spark.createDataFrame(rows, R))[1].count() == 0


def brute_pagerank(nodes, links, rounds=20, d=0.85):
    n, out = len(nodes), {v: sum(s == v for s, _ in links) for v in nodes}
    pr = dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        lost = sum(pr[v] for v in nodes if not out[v])
        pr = {v: d * sum(pr[s] / out[s] for s, t in links if t == v) + (1 - d) / n + d * lost / n for v in nodes}
    assert abs(sum(pr.values()) - 1) < 1e-9
    return {v: 10 * x / max(pr.values()) for v, x in pr.items()}


def test_pagerank(spark):
    links = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "d")]
    nodes = spark.createDataFrame([("u", v) for v in "abcdef"] + [("w", "z")], "user_id string, id string")
    edges = spark.createDataFrame([("u", s, t) for s, t in links], "user_id string, source string, target string")
    got = {(r.user_id, r.id): r.pagerank for r in p.pagerank(nodes, edges).collect()}
    want = brute_pagerank(list("abcdef"), links)
    assert got.pop(("w", "z")) == 10 and all(abs(got["u", v] - x) < 1e-9 for v, x in want.items()) and len(got) == 6


def test_hierarchy(spark):
    nodes = spark.createDataFrame([("u", v) for v in "abcdex"] + [("w", v) for v in "pqr"], "user_id string, id string")
    edges = [("u", "a", "b"), ("u", "b", "c"), ("u", "a", "c"), ("u", "d", "e"), ("u", "e", "d"), ("w", "p", "q"), ("w", "q", "p"), ("w", "r", "r")]
    got = {(r.user_id, r.id): r.level for r in p.hierarchy_levels(nodes, spark.createDataFrame(edges, "user_id string, source string, target string")).collect()}
    assert got == {("u", "a"): 0, ("u", "x"): 0, ("u", "b"): 1, ("u", "c"): 1, ("u", "d"): 2, ("u", "e"): 2, ("w", "p"): 0, ("w", "q"): 1, ("w", "r"): 2}


def test_deep_hierarchy(spark):
    depth = 25
    nodes = spark.createDataFrame([("u", f"n{i:02}") for i in range(depth)], "user_id string, id string")
    links = spark.createDataFrame([("u", f"n{i:02}", f"n{i + 1:02}") for i in range(depth - 1)], "user_id string, source string, target string")
    assert {r.id: r.level for r in p.hierarchy_levels(nodes, links).collect()} == {f"n{i:02}": i for i in range(depth)}


def test_intermediate_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    kept = shared.stored(spark.range(3))
    assert kept.count() == 3 and len(list(tmp_path.iterdir())) == 1
    shared.discard(kept, None, spark.range(1))
    assert not list(tmp_path.iterdir())
    nodes = spark.createDataFrame([("u", v) for v in "abc"], "user_id string, id string")
    links = spark.createDataFrame([("u", "a", "b"), ("u", "b", "c")], "user_id string, source string, target string")
    levels, ranks = p.hierarchy_levels(nodes, links), p.pagerank(nodes, links)
    assert levels.count() == 3 and ranks.count() == 3
    assert len(list(tmp_path.iterdir())) == 3  # what the two results read
