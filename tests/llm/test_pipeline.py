import hashlib

import corpus_pipeline as cp
import sentencepiece
from lattica.llm.pieces import production_model

from test_decontaminate import brute as contaminated
from test_jaccard import brute as components
from test_line_dedup import brute as lines

ROW = "doc_id long, text string, lang string, source string, n_chars long"


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = cp.language(spark, docs, path)
    assert kept.columns == docs.columns and docs.count() - kept.count() <= 2
    rows = [tuple(r) for r in kept.collect()]
    cut = cp.lines(spark, kept, path)
    assert cut.columns == docs.columns
    by_line = {r[0]: r[3] for r in lines([r[:2] for r in rows])}
    assert plain(cut) == sorted(((r[0], by_line[r[0]], r[2], r[3], len(by_line[r[0]])) for r in rows), key=str)
    rows = [tuple(r) for r in cut.collect()]
    single = cp.duplicates(spark, cut, path)
    leaders = {r[0] for r in components([r[:2] for r in rows]) if r[0] == r[2]}
    assert plain(single) == sorted((r for r in rows if r[0] in leaders), key=str)
    rows = [tuple(r) for r in single.collect()]
    clean = cp.benchmark(spark, single, path)
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated([r[:2] for r in rows], items) if r[4]}
    assert bad and plain(clean) == sorted((r for r in rows if r[0] not in bad), key=str)
    lib, sha = sentencepiece.SentencePieceProcessor(model_file=production_model()), lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in clean.collect():
        ids = lib.encode(r.text)
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    assert plain(cp.tokens(spark, clean, path)) == sorted(want, key=str)
    assert plain(cp.run(spark, path)) == sorted(want, key=str)


def test_stages_with_odd_rows(spark):
    path = "/root/testdata/sf0.001"
    rows = [(None, "a text without an id", None, None, None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "the same text of the two rows", "en", "s", 5), (3, "the same text of the two rows", "en", "s", 5), (4, "le texte et la vie " * 3000, "fr", None, 9)]
    odd = spark.createDataFrame(rows, ROW).selectExpr("*", "1 AS row", "'k' AS kept", "2 AS node")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, path)
        assert out.columns == odd.columns
        assert {(r.doc_id, r.lang) for r in out.collect()} >= {(3, "en"), (4, "fr")} | ({(None, None)} if name != "language ID" else set())
        assert out.where("doc_id = 3").count() == 2
        assert stage(spark, odd.limit(0), path).count() == 0
    assert cp.tokens(spark, odd, path).count() == 6 and cp.tokens(spark, odd.limit(0), path).count() == 0


def test_repeated_ids_are_judged_by_their_own_texts(spark):
    a, b = "one text of more than five words here", "another text of more than five words there"
    rows = [(1, a), (2, a), (2, b), (3, b), (3, None), (4, None), (5, b.upper()), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS copy", "2 AS leader_id", "3 AS leader_copy")
    got = cp.duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (2, b), (3, None), (4, None), (None, a)], key=str)
