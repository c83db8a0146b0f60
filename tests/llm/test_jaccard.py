import random

import numpy as np
from lattica.llm import jaccard


def brute(docs, percent=75):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and docs[i][0] is not None and docs[j][0] is not None:
                a, b = len(sets[i]), len(sets[j])
                if 4 * min(a, b) >= 3 * max(a, b):
                    c = len(sets[i] & sets[j])
                    if 100 * c >= percent * (a + b - c):
                        parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((docs[i][0], len(sets[i]), least.get(root(i)) if docs[i][0] is not None else None) for i in range(len(docs))), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_edges(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop")
    docs = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, " \n"), (None, "one"), (6, "a b c d"), (7, "a b\tc  d"), (7, "a b c d")]
    base = [word() for _ in range(60)]
    for k in range(40):
        text = list(base)
        for _ in range(k % 5):
            text[r.randrange(60)] = word()
        docs.append((100 + k, " ".join(text)))
    passage = [word() for _ in range(40)]
    for k in range(60):
        docs.append((200 + k, " ".join(passage + [word() for _ in range(r.randrange(30))])))
    docs.append((999, " ".join(word() for _ in range(30_000))))
    docs.append((998, docs[-1][1] + " x"))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS n", "'a' AS list")
    assert got(jaccard.near_duplicates(df)) == brute(docs)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    few = [(1, None), (2, ""), (3, "a b"), (4, "A b"), (5, "c")]
    assert got(jaccard.near_duplicates(spark.createDataFrame(few, "doc_id long, text string"))) == brute(few)


def test_split_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for k in range(60):
        text = list(base)
        for _ in range(r.randrange(6)):
            text[r.randrange(80)] = f"x{r.randrange(50)}"
        docs.append((k, " ".join(text[: r.randrange(50, 80)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(jaccard.near_duplicates(df)) == brute(docs)


def test_parts_hold_every_pair_of_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 5)
    r = random.Random(8)
    rows = [("small", 4, n, r.randrange(3)) for n in range(4)]
    rows += [("large", 60, n, 0 if n < 40 else 1 if n < 52 else n) for n in range(60)]
    rows += [("one", 30, n, n) for n in range(30)]
    held = spark.createDataFrame(rows, "list string, members int, node long, label long")
    parts = {}
    for x in jaccard.parts_of(held).collect():
        parts.setdefault((x.list, x.part), []).append((x.node, x.label))
    met = {(key[0], a[0], b[0]) for key, some in parts.items() for a in some for b in some}
    for name, _, n, label in rows:
        for other, _, m, more in rows:
            assert name != other or label == more or (name, n, m) in met
    large = [some for key, some in parts.items() if key[0] == "large"]
    assert sum(map(len, large)) < 60 * 14 and all(len({label for _, label in some}) > 1 for some in large if len(some) > 5)
    assert jaccard.parts_of(held.where("list = 'small'")).count() == 4


def test_tree_keeps_every_pair():
    r = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = r.integers(0, 2**63, r.integers(5, 300)).astype(np.uint64)
        for _ in range(3):
            s = base.copy()
            s[r.integers(0, len(s), len(s) // 8)] = r.integers(0, 2**63, len(s) // 8).astype(np.uint64)
            sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    tree = jaccard.Tree(n, np.stack([jaccard.bitmap(s) for s in sets]), np.arange(len(sets)), 75)
    found = {tuple(sorted(p)) for a, b, _ in tree.pairs() for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if jaccard.similar(sets[i], sets[j], 75)}
    assert want and want <= found and len(found) < len(sets) ** 2 / 8
    wide = [jaccard.wide_bitmap(s) for s in sets]
    passed = {(i, j) for j in range(len(sets)) for i in range(j) if jaccard.may_reach((int(n[i]), int(n[j])), (wide[i], wide[j]), 75)}
    assert want <= passed and len(passed) < 2 * len(want) + 20


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(jaccard.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_pairs_behind_tested_best_ones(spark, monkeypatch):
    """A path a2, a1, b2, b1 of links, where bitmaps that are full rank a1-b2 last: b1 and b2 share their smallest token."""

    def path(seed):
        r = random.Random(seed)
        steps = [[f"{seed}w{i}" for i in range(200)]]
        for k, at in enumerate((20, 80, 140)):
            steps.append(steps[-1][:at] + [f"{seed}x{k}{i}" for i in range(17 + r.randrange(7))] + steps[-1][at + 20 :])
        return [" ".join(w) for w in steps]

    def fits(texts):
        a2, a1, b2, b1 = (jaccard.shingles(*jaccard.hashed_words([t.encode()]))[0] for t in texts)
        firsts = [int(s[0]) for s in (a2, a1, b2, b1)]
        linked = [jaccard.similar(x, y, 75) for x, y in ((a2, a1), (a1, b2), (b2, b1))]
        apart = [jaccard.similar(x, y, 75) for x, y in ((a2, b2), (a1, b1), (a2, b1))]
        ranked = len(a1) < len(b2) == len(a2) > len(b1) and jaccard.node_of(a2) < jaccard.node_of(a1) and jaccard.node_of(b2) < jaccard.node_of(b1)
        return all(linked) and not any(apart) and ranked and firsts[2] == firsts[3] and len(set(firsts)) == 3

    def full(s):
        return np.full(jaccard.BITMAP, 2**64 - 1, np.uint64)

    texts = next(t for t in map(path, range(20_000)) if fits(t))
    monkeypatch.setattr(jaccard, "bitmap", full)
    docs = list(enumerate(texts, 1))
    assert got(jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
