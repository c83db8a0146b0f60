import random
import re
import zlib

import numpy as np
from lattica.llm import quality_model as qm
from lattica.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), failed


def test_counts_against_brute_force(spark):
    r = random.Random(0)
    texts = [None, "", " \n\n", "a", "é ß\x0b中 b", "a b c d e\n" * 3, "x" * 100_000]
    texts += ["".join(r.choice("ab c\n#|É\t") for _ in range(r.randrange(200))) for _ in range(60)]
    rows = [*enumerate(texts), (3, "a"), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "true AS kept", "'x' AS words")
    got = sorted(((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in qr.assess(df).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=str)
    assert all(not x.kept for x in qr.assess(df).where("base_failed").collect())
    assert qr.assess(df.limit(0)).count() == 0


def test_line_rules(spark):
    prose = "\n".join(f"Here w{i}a w{i}b w{i}c stand in plain w{i}d text, and w{i}e w{i}f end it." for i in range(6))
    menu = "Home | News | Sport | Weather"
    assert qr.line_fault(menu, menu.split()) == "navigation"
    for line, fault in (("All Rights Reserved by us", "boilerplate"), ("a### b$$$ c%%%", "punctuation"), ("BUY!! NOW!! IT IS FREE!!", "punctuation"), ("THIS IS LOUD TEXT FOR YOU", "case"), ("A plain line of text.", None), ("A | B", None), ("Ä | Ö | Ü", None)):
        assert qr.line_fault(line, line.split()) == fault, line
    for line, fault in (("© 2024 Müller", "boilerplate"), ("Alle Rechte vorbehalten.", "boilerplate"), ("TOUS DROITS RÉSERVÉS", "boilerplate"), ("see https://a.example/x now", "link"), ("www.a.example", "link"), ("a nowww.x thing", None), ("one two three four five six seven eight https://a.example", None)):
        assert qr.line_fault(line, line.split()) == fault, line
    rows = [(1, prose), (2, f"{prose}\n{menu}"), (3, "\n".join(menu.replace("News", f"N{i}") for i in range(9)))]
    got = {x.doc_id: x for x in qr.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].clean_text == prose and got[1].n_lost_words == 0
    assert got[2].kept and got[2].clean_text == prose and not got[3].kept and got[3].clean_text == ""


def test_rules_keep_good_documents(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = qr.op7_quality_rules(spark, path).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg({"kept": "count"}).collect()
    kept = {r.quality: r[1] for r in qr.op7_quality_rules(spark, path).where("kept").join(labels, "doc_id").groupBy("quality").count().collect()}
    whole = {r.quality: r[1] for r in got}
    assert kept[1] == whole[1] and kept.get(0, 0) < 0.1 * whole[0]


def test_gradients_against_differences():
    r = np.random.default_rng(0)
    texts = [bytes(r.integers(97, 123, n).astype(np.uint8)) for n in (0, 3, 255, 256, 700, 1500)]
    y = np.array([0, 1, 0, 1, 1, 0], np.float32)
    net = qm.Network()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}

    def loss():
        m, _ = net.maxima(*net.layout(texts))
        chunks = np.maximum(np.diff(net.layout(texts)[1]) - 1, 1)
        logits = np.maximum(m + net.weights["bias"], 0) @ net.weights["out"] + net.weights["shift"]
        p = 1 / (1 + np.exp(-np.add.reduceat(logits, np.cumsum(chunks) - chunks) / chunks))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(texts, y)
    for k, w in net.weights.items():
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in w.shape)
            if k == "bytes":
                at = (int(r.integers(97, 123)), at[1])
            old, eps = w[at], 1e-5
            w[at] = old + eps
            up = loss()
            w[at] = old - eps
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-4, (k, at)


def test_score_sees_the_whole_text_alone():
    net = qm.Network()
    texts = [b"", b"a", b"x" * 5000, b"y" * 256, b"z" * 257]
    together = net.score(texts)
    assert np.allclose(together, [net.score([t])[0] for t in texts], atol=1e-6)
    assert abs(net.score([b"x" * 4999 + b"#"])[0] - together[2]) > 0 and ((0 <= together) & (together <= 1)).all()


def test_held_out(spark):
    path = "/root/testdata/sf0.1"
    got = qm.op8_quality_classifier(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    y, s = np.array([r.quality for r in got]), np.array([r.score for r in got])
    better = (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert better > 0.97 and ((s >= 0.3) == y).mean() > 0.95


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, "good text here. "), (2, "### $$$ %%%"), (2, "### $$$ %%%"), (None, "x"), (4, None), (5, ""), (6, "long " * 50_000)], "doc_id long, text string").selectExpr("*", "1 AS y", "2 AS score")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (4, None), (4, 1)], "doc_id long, quality int")
    net = qm.fit(docs, labels)
    got = qm.score(docs, net).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert qm.score(docs.limit(0), net).count() == 0
    assert len({r.score for r in qm.score(docs, qm.fit(docs, labels.limit(0))).collect() if r.doc_id == 2}) == 1


def naive_score(net, text):
    """One chunk of 512 bytes after another, 256 bytes apart; a window of 8 bytes every 4."""
    w = net.weights
    half = qm.STRIDE * qm.HALF
    n = len(text) // half + 1
    data = text + bytes(n * half - len(text))
    wide = qm.STRIDE * qm.EMBEDDING
    respond = []
    for at in range(0, len(data), qm.STRIDE):
        own = w["bytes"][list(data[at : at + qm.STRIDE])].reshape(wide)
        follows = data[at + qm.STRIDE : at + 2 * qm.STRIDE]
        second = w["bytes"][list(follows)].reshape(wide) @ w["filters"][1] if follows else 0
        respond.append(own @ w["filters"][0] + second)
    respond = np.array(respond).reshape(n, qm.HALF, qm.FILTERS)
    scores = []
    for c in range(max(n - 1, 1)):
        m = respond[c : c + 2].reshape(-1, qm.FILTERS).max(axis=0)
        scores.append(float(np.maximum(m + w["bias"], 0) @ w["out"] + w["shift"][0]))
    return 1 / (1 + np.exp(-np.mean(scores)))


def test_score_against_brute_force(monkeypatch):
    r = np.random.default_rng(3)
    net = qm.Network()
    texts = [bytes(r.integers(32, 127, n).astype(np.uint8)) for n in (0, 1, 7, 8, 255, 256, 257, 511, 512, 513, 2000, 2560, 5000)]
    want = [naive_score(net, t) for t in texts]
    assert np.allclose(net.score(texts), want, atol=2e-6)
    for block in (1, 2, 3, 7):  # long texts in blocks
        monkeypatch.setattr(qm, "BLOCK", block)
        assert np.allclose(net.score(texts), want, atol=2e-6)
