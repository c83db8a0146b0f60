import glob
import hashlib
import random
import re

import pyarrow.parquet as pq

from lattica.llm import decontaminate as dc
from lattica.sources.shared import LARGE_ROWS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
WORDS = lambda t: WORD.findall(lower(t))


def brute(docs, items, width=13):
    wins = {}
    for item, text in items:
        w = WORDS(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    lengths = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        w, hit, met = WORDS(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    met |= found
        out.append((doc, len(w), len(hit), tuple(sorted(met)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in df.collect()), key=str)


def test_edges(spark):
    twelve = " ".join(f"w{i}" for i in range(12))
    docs = [(1, None), (2, ""), (3, "Alpha, BETA"), (3, "Alpha, BETA"), (None, f"x {twelve} w12 Éa"), (5, f"{twelve}\nw12--W13 alpha beta"), (6, "É é"), (7, "alpha x beta")]
    items = [(10, f"{twelve} w12 w13"), (11, "alpha beta"), (12, "alpha  Beta!"), (None, "x"), (13, None), (14, "..."), (15, "É")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS spans", "0 AS copy")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term")
    want = brute(docs, [x for x in items if x[0] is not None])
    assert got(dc.contamination(d, i)) == want
    near = {r.doc_id: r.near for r in dc.contamination(d, i).collect()}
    assert near[7] == ["11", "12"]
    assert dc.contamination(d.limit(0), i).count() == 0
    assert {x[2] for x in got(dc.contamination(d, i.limit(0)))} == {0}


def near_brute(docs, items, width, slop):
    """Items with a window and a start from which each word is at most slop words away, without those that match exactly."""
    out = []
    for doc, text in docs:
        w, met = WORDS(text), set()
        for item, other in items:
            own = WORDS(other)
            for i in range(max(1, len(own) - width + 1) if own else 0):
                win = own[i : i + width]
                places = [[p for p, x in enumerate(w) if x == t] for t in win]
                if any(all(any(abs(p - s - k) <= slop for p in ps) for k, ps in enumerate(places)) for s in range(-slop - len(win), len(w) + slop)):
                    met.add(str(item))
                    break
        exact = set(next(x[3] for x in brute([(doc, text)], items, width)))
        out.append((doc, tuple(sorted(met - exact))))
    return sorted(out)


def test_proximity_against_brute_force(spark):
    r = random.Random(3)
    docs = [(1, "zz yy"), (2, "b a c"), (3, "a c a c"), (4, "c x x b a"), (5, "c"), (6, "b a")]
    docs += [(10 + k, " ".join(r.choice("abcdefg") for _ in range(r.randrange(12)))) for k in range(60)]
    items = [(0, "a b c"), (1, "b c"), (2, "g f e d"), (3, "e a b a"), (4, "f")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    for width, slop in ((13, 1), (13, 2), (3, 2), (2, 40)):
        got = sorted((x.doc_id, tuple(x.near)) for x in dc.search(d, i, width=width, slop=slop).collect())
        assert got == near_brute(docs, items, width, slop)
    assert dict(got)[1] == ()


def test_very_long_texts(spark):
    words = [f"w{k % 5003}" for k in range(1_500_000)]
    phrase = [f"q{k}" for k in range(14)]
    words[700_000:700_014] = phrase
    words[1_499_987:] = phrase[:13]
    docs = [(1, " ".join(words)), (2, " ".join(phrase[:13])), (3, "w1")]
    got = {x.doc_id: x for x in dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(phrase)), (8, "w1")], "item_id long, text string")).collect()}
    assert len(docs[0][1]) > 8 << 20
    ones = words.count("w1")
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (1_500_000, 27 + ones, ["7", "8"])
    assert (got[2].n_hit, got[2]["items"], got[3]["items"]) == (13, ["7"], ["8"])


def test_blocks(spark, monkeypatch):
    docs = [(k, f"a{k} b c d{k % 3} e") for k in range(20)] + [(3, "a3 b c d0 e")] * 2
    items = [(k, f"b c d{k}") for k in range(3)] + [(9, "e"), (8, "c")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = got(dc.contamination(d, i))
    assert one == brute(docs, items)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 100)
    assert got(dc.contamination(d, i)) == one


def test_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(dc.contamination(docs, items)) == want
    assert any(x[4] for x in want)
    digest = {r.doc_id: (r.n_items, r.items_sha256) for r in dc.op1_decontamination(spark, path).collect()}
    assert digest == {x[0]: (len(x[3]), hashlib.sha256(",".join(x[3]).encode()).hexdigest()) for x in want}


def test_blocks_of_the_stored_index_are_bounded(spark):
    """Rows of the index are MBs; Parquet by itself would hold a hundred of them before it ends a block, and a reader a whole block."""
    rng = random.Random(3)
    rows = [(n, " ".join(f"{rng.randrange(1 << 20):x}" for _ in range(250_000))) for n in range(12)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        index = dc.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    finally:
        spark.conf.set(key, before)
    files = [pq.ParquetFile(f) for f in glob.glob(f"{index.stored_at}/*.parquet")]
    blocks = [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]
    assert sum(b.num_rows for b in blocks) == len(rows)
    assert max(b.total_byte_size for b in blocks) < 3 * LARGE_ROWS["parquet.block.size"]
