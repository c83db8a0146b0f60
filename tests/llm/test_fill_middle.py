import hashlib
import random
import re

from lattica.llm import fill_middle
from pyspark.sql import functions as F


def brute(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS form", "'y' AS output")
    out = fill_middle.fill_in_middle(df)
    return sorted(map(tuple, out.withColumn("r", fill_middle.restored(F.col("output"), F.col("form"))).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    alphabet = ["ab", "Z", " ", "\n", "é", "ß", "中", "😀", "½", "<", "P", ">", "\x00", "\r", "́", "7"]
    docs = [(i, "".join(rng.choices(alphabet, k=rng.randrange(40)))) for i in range(600)]
    docs += [(1, "same"), (1, "same"), (1, None), (None, "no id here"), (None, None), (-5, "minus five"), (700, "a<S>b"), (701, "x<M>"), (702, "<P>"), (703, "S><P" * 5), (704, "ends <S"), (2**62, "large id, last")]
    got = run(spark, docs)
    assert got == sorted((brute(*d) for d in docs), key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert run(spark, []) == []


def test_long_texts_are_split_in_segments(spark, monkeypatch):
    rng = random.Random(4)
    words = ["alpha", "été", " ", "\n", "中中", "😀", "x"]
    for size in (5, 64):
        for _ in range(50):
            text = "".join(rng.choices(words, k=200)).encode()
            parts = fill_middle.segments(text, size)
            assert b"".join(parts) == text
            assert [u for p in parts for u in re.findall(r"[A-Za-z]+|[^A-Za-z]", p.decode())] == re.findall(r"[A-Za-z]+|[^A-Za-z]", text.decode())
    docs = [(i, "".join(rng.choices(words, k=900_000)) if i != 3 else "a" * 3_000_000 + " b") for i in range(1, 6)] + [(9, "short")]
    assert run(spark, docs) == sorted((brute(*d) for d in docs), key=str)
