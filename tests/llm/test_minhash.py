import random

import numpy as np
from lattica.llm import jaccard, minhash


def brute(docs, percent=80):
    """Links between ids, by any of their texts."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = {d: d for d, _ in docs if d is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (x, _) in enumerate(docs):
        for j, (y, _) in enumerate(docs[:i]):
            if x is not None and y is not None and sets[i] and sets[j]:
                a, b = len(sets[i]), len(sets[j])
                if 100 * min(a, b) >= percent * max(a, b):
                    c = len(sets[i] & sets[j])
                    if 100 * c >= percent * (a + b - c):
                        a, b = root(x), root(y)
                        parent[max(a, b)] = min(a, b)
    return sorted(((d, len(s), root(d) if d is not None else None, d is None or root(d) == d) for (d, _), s in zip(docs, sets, strict=True)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_edges(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop")
    docs = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, " \n"), (None, "one"), (None, None), (6, "a b c d"), (7, "a b\tc  d"), (7, "a b c d"), (8, "a b"), (9, "É b"), (10, "é b")]
    base = [word() for _ in range(60)]
    for k in range(40):
        text = list(base)
        for _ in range(k % 5):
            text[r.randrange(60)] = word()
        docs.append((100 + k, " ".join(text)))
    # an id of two texts, which belong to different groups, and an id all texts of which are copies
    docs += [(50, docs[20][1]), (50, "quite another text of some more words here"), (51, "Quite another text of some more words here"), (50, None)]
    passage = [word() for _ in range(40)]
    for k in range(60):
        docs.append((200 + k, " ".join(passage + [word() for _ in range(r.randrange(30))])))
    docs.append((999, " ".join(word() for _ in range(30_000))))
    docs.append((998, docs[-1][1] + " x"))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS n", "'a' AS list", "3 AS h1", "true AS kept")
    assert got(minhash.minhash_duplicates(df)) == brute(docs)
    assert minhash.minhash_duplicates(df.limit(0)).count() == 0
    few = [(1, None), (2, ""), (3, "a b"), (4, "A b"), (5, "c")]
    assert got(minhash.minhash_duplicates(spark.createDataFrame(few, "doc_id long, text string"))) == brute(few)


def test_chains_and_split_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for k in range(60):
        text = list(base)
        for _ in range(r.randrange(6)):
            text[r.randrange(80)] = f"x{r.randrange(50)}"
        docs.append((k, " ".join(text[: r.randrange(50, 80)])))
    chain = [f"c{i}" for i in range(60)]
    docs += [(500 - k, " ".join([*chain[k * 2 :], *(f"d{i}" for i in range(k * 2))])) for k in range(20)]  # each like the next one only
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert got(minhash.minhash_duplicates(df)) == want
    assert {c for d, _, c, _ in want if d > 400} == {481}
    assert got(minhash.minhash_duplicates(df, 60)) == brute(docs, 60)


def test_estimates_and_bounds():
    rng = np.random.default_rng(2)
    bands = minhash.bands_of(80)
    slots = bands * minhash.ROWS
    assert (1 - 0.8**minhash.ROWS) ** bands <= minhash.MISSED and bands == 40
    tokens = rng.integers(0, 1 << 64, 40_000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        common = round(2 * 1000 * share / (1 + share))
        pairs = [(t[:1000], np.concatenate([t[:common], t[1000 : 2000 - common]])) for t in (rng.permutation(tokens)[:2000] for _ in range(100))]
        least = minhash.minima([s for p in pairs for s in p], slots)
        bits = minhash.packed(least)
        assert bits.shape == (200, slots * minhash.BITS // 8)
        estimates = minhash.estimate(bits[::2], bits[1::2])
        j = common / (2000 - common)
        assert abs(estimates.mean() - j) < 0.015  # corrected for chance: 100 pairs, a deviation under 0.05 each
        assert abs((least[::2] == least[1::2]).mean() - j) < 0.015
        by_hand = np.mean([np.mean([(x & np.uint64(3)) == (y & np.uint64(3)) for x, y in zip(a, b, strict=True)]) for a, b in zip(least[::2], least[1::2], strict=True)])
        assert abs((estimates.mean() * 0.75 + 0.25) - by_hand) < 1e-9
        reach = minhash.apart(bits[::2], bits[1::2]) <= minhash.most_apart(80, slots)
        assert reach.all() if share >= 0.8 else not reach.any() if share <= 0.2 else True


def test_wide_bitmaps_lose_no_pair(monkeypatch):
    """Pairs at the threshold pass whatever widths they have; most pairs well below it do not."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(minhash, "MOST_WIDE", 64)
    sets = []
    for n in (3, 40, 250, 300, 600, 3000):
        base = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        sets.append(base)
        for share in (0.5, 0.7, 0.8, 0.81, 0.9, 0.99):
            common = base[: max(round(n * 2 * share / (1 + share)), 1)]
            sets.append(np.unique(np.concatenate([common, rng.integers(0, 1 << 64, n - len(common), dtype=np.uint64)])))
    n = np.array([len(s) for s in sets])
    wide = minhash.Wide([minhash.wide_bitmap(s).tobytes() for s in sets], n, 80)
    a, b = np.triu_indices(len(sets), 1)
    passed = wide.may_reach(a, b)
    similar = np.array([jaccard.similar(sets[i], sets[j], 80) for i, j in zip(a, b, strict=True)])
    assert passed[similar].all() and similar.sum() > 15 and passed[~similar].mean() < 0.1
