from pyspark.sql import functions as F

from lattica.llm import language


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = language.op2_language_id(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n, rejected = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*"), F.avg(F.col("rejected").cast("int"))).first()
    assert n > 200 and right > 0.98 and rejected < 0.01


def test_edges(spark):
    rows = [(1, "die der und nicht ein", "de"), (2, "le la et les dans", "fr"), (3, None, "fr"), (4, "le la et", None), (5, "123 !!", "de"), (6, "", "de"), (None, "und der", "de"), (1, "die der und nicht ein", "de"), (7, "der " * 200_000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0.5D AS score", "'x' AS lang_pred", "1 AS row")
    model = language.fit(docs)
    assert set(model.langs) == {"de", "fr"}
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {(r.row.doc_id, r.row.text): r for r in got}
    for doc, text in ((3, None), (5, "123 !!"), (6, "")):
        assert (by[doc, text].lang_pred, by[doc, text].score, by[doc, text].rejected) == ("und", 0.0, True)
    assert by[1, rows[0][1]].lang_pred == "de" and by[2, rows[1][1]].lang_pred == "fr" and by[7, rows[-1][1]].lang_pred == "de"
    assert 0 < by[4, "le la et"].score <= 1
    empty = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_rejects_what_was_not_learned(spark):
    import random

    r = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.trained(docs)
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    greek = "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση."
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10))) for _ in range(60))
    odd = [finnish, finnish * 5, greek, noise, noise * 5]
    langs, scores, rejected = model.predict(odd)
    assert rejected.all(), (sorted(set(model.langs)), langs, scores, model.floors.round(3).tolist())


def naive_counts(text):
    """Hashed trigrams of lower-cased letters, blanks for the rest, whose middle is a letter."""
    padded = [c if c.isalpha() else " " for c in f"  {(text or '').lower()}  "]
    out = {}
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        if b != " ":
            code = (ord(a) * 0x9E3779B1 & 0xFFFFFFFF) ^ (ord(b) * 0x85EBCA77 & 0xFFFFFFFF) ^ (ord(c) * 0xC2B2AE3D & 0xFFFFFFFF)
            code = (code ^ code >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            bucket = code >> 33 - language.DIMS.bit_length()
            out[bucket] = out.get(bucket, 0) + 1
    return out


def test_vectors_and_nearest_against_brute_force(monkeypatch):
    import math
    import random

    import numpy as np

    r = random.Random(2)
    texts = [None, "", "1 !", "½ ②", "Ⅷ", "é", "ab", "😀 𝐀b ab", *("".join(r.choice("abcé ß.𝐀😀") for _ in range(r.randrange(80))) for _ in range(40))]
    idf = np.array([r.uniform(1, 5) for _ in range(language.DIMS)], np.float32)
    monkeypatch.setattr(language, "BLOCK", 7)
    got = language.vectors(texts, idf)
    plain = []
    for text, row in zip(texts, got, strict=True):
        weights = {k: math.log1p(n) * float(idf[k]) for k, n in naive_counts(text).items()}
        norm = math.sqrt(sum(v * v for v in weights.values()))
        plain.append({k: v / norm for k, v in weights.items()})
        assert np.allclose(row, [plain[-1].get(k, 0) for k in range(language.DIMS)], atol=1e-5)
    centroids = np.array([[r.uniform(0, 1) for _ in range(language.DIMS)] for _ in range(6)], np.float32)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    centroids[4] = centroids[1]  # a tie goes to the first
    floors = np.full((6, len(language.LENGTHS)), 0.02)
    model = language.Model(idf, ["a", "b", "c", "d", "e", "f"], centroids, floors)
    langs, scores, rejected = model.predict(texts)
    for text, v, lang, score, no in zip(texts, plain, langs, scores, rejected, strict=True):
        near = [sum(x * float(c[k]) for k, x in v.items()) for c in centroids]
        if not any(ch.isalpha() for ch in text or ""):
            assert (lang, score, no) == ("und", 0.0, True)
        else:
            assert near["abcdef".index(lang)] >= max(near) - 1e-6 and lang != "e" and abs(score - max(near)) < 1e-5 and no == (score < 0.02)
