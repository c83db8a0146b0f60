import random
import re
import zlib
from collections import Counter

from lattica.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = Counter()
    for doc, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def brute_groups(words):
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = (n, len(others), form, words[form] if form else None)
    rows = []
    for w, (n, n_near, form, form_n) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.append((w, n, n_near, form, form_n, root))
    return sorted(rows)


def groups(spark, words, **kw):
    return sorted(map(tuple, spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long"), **kw).collect()))


def test_words_against_brute_force(spark):
    rng = random.Random(1)
    words = ["Hello", "WORLD", "Straße", "ÀÉÎ×÷", "naïve", "abcde", "ÉTÉÉÉ", "übermäßig", "œuvre", "Жук", "don't", "x1y", "abcdefgh"]
    docs = [(i, " ".join(rng.choices(words, k=60))) for i in range(150)]
    docs += [(1, None), (2, ""), (None, "Hello Hello Hello"), (7, "Hello"), (7, "Hello"), (8, "½ 12 \n"), (-3, "naïve " * 50), (9, "z" * 70_000 + " " + "z" * 70_000), (10, "z" * 70_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'w' AS word", "1 AS n")
    got = {r.word: r.n for r in spelling.vocabulary(df).collect()}
    want = brute_words(docs)
    assert got == want and "z" * 70_000 in got and any(len(w) == len("übermäßig") - 1 for w in got)
    assert spelling.vocabulary(df.limit(0)).count() == 0


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "AT_ONCE", 64)
    text = ("Wörter und " * 40 + "é" * 100 + " " + "x" * 300 + "–—ab ") * 3
    assert re.findall("[A-Za-zÀ-ÿ]+", text) == [w.decode() for b in spelling._blocks(text.encode()) for w in spelling.RUN.findall(b)]


def test_groups_against_brute_force(spark):
    for seed, alphabet, size in ((1, "ab", 9), (2, "abcdé", 7), (3, "aé", 12)):
        rng = random.Random(seed)
        words = {"".join(rng.choices(alphabet, k=rng.randint(5, size))): rng.choice([3, 3, 5, 6, 7, 12, 25, 100]) for _ in range(300)}
        assert groups(spark, words) == brute_groups(words)
    assert groups(spark, {"aaaaa": 3}) == [("aaaaa", 3, 0, None, None, "aaaaa")]
    assert spelling.spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0


def test_large_partitions_are_parted(spark):
    rng = random.Random(5)
    words = {"same" + "".join(rng.choices("abc", k=rng.randint(1, 5))) + rng.choice(["", "tail"]): rng.randint(3, 40) for _ in range(400)}
    words |= {"a" * k: k for k in range(5, 40)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = sorted((w, k, words[b], b) for w in words if (k := len(o := [x for x in words if near(w, x)])) for b in [min(o, key=lambda x: (-words[x], x))])
    for group in (2, 7, 50, 4096):
        assert sorted(map(tuple, spelling.near_words(df, group).collect())) == want


def test_acceptor_is_minimal_and_its_composition_complete():
    words = sorted({"tap", "taps", "top", "tops", "tip", "stop", "stops"})
    acceptor = spelling.Acceptor(words)
    assert len(acceptor.arcs) == 8  # the start, s, st, t or what is read after it, p, and the end with or without s
    pairs = {tuple(sorted(p)) for p in acceptor.accepted()}
    assert pairs == {(a, b) for a in words for b in words if a < b and near(a, b)}
    long = ["q" * 50_000 + x + "r" * 50_000 for x in "ab"] + ["q" * 50_000 + "r" * 50_000]
    assert len(list(spelling.Acceptor(sorted(long)).accepted())) == 3
    assert list(spelling.Acceptor([]).accepted()) == []
