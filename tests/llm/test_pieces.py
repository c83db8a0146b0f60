import hashlib
import random

import sentencepiece
from lattica.llm import pieces

MODEL = pieces.production_model()


def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_any_text_like_the_library():
    r, coder, lib = random.Random(0), pieces.Pieces(MODEL), library()
    assert coder.pattern.findall("▁ab.▁cd") == ["▁ab", ".", "▁cd"]
    texts = ["", " ", "  ", "a", " a ", "\n", "▁", "▁▁ a▁b", "é́ ß İ 中文 😀 \x00 \x01", "<s> </s> <unk> <0x0A>", "x" * 5000, "word. " * 300, "a.b,c!!d ...  ,, e", "\t\n a\n\n.b"]
    texts += ["".join(r.choice("abcdeth ▁.,!?\n\"'()#$|<>-01é中😀 ") for _ in range(r.randrange(80))) for _ in range(3000)]
    assert coder.encode(texts) == lib.encode(texts)
    for t in texts[:400]:
        s = "▁" + t.replace(" ", "▁")
        assert coder._merge_short(s) == coder._merge_long(s)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    coder, lib, r = pieces.Pieces(MODEL), library(), random.Random(1)
    for _ in range(20):
        texts = [" ".join("".join(r.choice("abc") for _ in range(3)) for _ in range(20)) for _ in range(3)]
        assert coder.encode(texts) == lib.encode(texts)
        assert len(coder.young) <= 110 and len(coder.old) <= 110


def test_queries(spark):
    path, lib = "/root/testdata/sf0.001", library()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in docs.collect():
        ids = lib.encode(r.text)
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.op9_sentencepiece(spark, path).collect()} == want
    back = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = pieces.encode(df, MODEL).collect()
    lib = library()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), lib.encode(t or "")) for d, t in rows)
    assert pieces.digests(df.limit(0), MODEL).count() == 0 and pieces.digests(df, MODEL).count() == len(rows)


def test_very_long_text(monkeypatch):
    coder = pieces.Pieces(MODEL)
    text = " ".join(f"word{i % 700} é{i} the end." for i in range(20_000))
    monkeypatch.setattr(pieces, "REMEMBERED", 5000)
    assert coder.encode([text]) == [coder.library.encode(text)] == coder.encode([text, None])[:1]
