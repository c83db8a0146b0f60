import random
from collections import defaultdict

from lattica.llm import packing as pk


def test_best_fit_decreasing():
    r = random.Random(0)
    for _ in range(40):
        capacity = r.choice([7, 16, 100])
        lengths = [r.randrange(3 * capacity) for _ in range(r.randrange(60))]
        bins = pk.best_fit_decreasing(lengths, capacity)
        got = defaultdict(list)
        for b in bins:
            assert 0 < sum(n for _, _, n in b) <= capacity
            for d, start, n in b:
                got[d].append((start, n))
        for d, n in enumerate(lengths):
            at = 0
            for start, size in sorted(got[d]):
                assert start == at
                at += size
            assert at == n
        # the same bins as with a plain search for the fullest bin that fits
        rests, plain = sorted((n % capacity for n in lengths if n % capacity), reverse=True), []
        for n in rests:
            fit = [f for f in plain if f >= n]
            if fit:
                plain.remove(min(fit))
                plain.append(min(fit) - n)
            else:
                plain.append(capacity - n)
        whole = sum(n // capacity for n in lengths)
        assert len(bins) == whole + len(plain)


def test_round_trip(spark):
    r = random.Random(1)
    texts = [None, "", "x", "word " * 9000, *(" ".join(r.choice(["alpha", "beta", "Übung", "9", "!"]) for _ in range(r.randrange(400))) for _ in range(40))]
    rows = [*enumerate(texts), (7, texts[7]), (None, "lost id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "'a' AS n_tokens").repartition(3)
    coder, capacity, pieces = pk.byte_bpe(), 256, defaultdict(list)
    packed = pk.pack(df, capacity=capacity).collect()
    for p in packed:
        ids = pk.matrix([p.ids])[0]
        assert len(ids) == capacity and p.cu_seqlens[0] == 0 and p.cu_seqlens[-1] == p.n_tokens
        assert p.position_resets == (p.cu_seqlens if p.n_tokens < capacity else p.cu_seqlens[:-1])
        assert (ids[p.n_tokens :] == 50256).all()
        for d, start, a, b in zip(p.doc_ids, p.piece_starts, p.cu_seqlens, p.cu_seqlens[1:], strict=False):
            pieces[d].append((start, ids[a:b].tolist()))
    want = defaultdict(list)
    for d, t in rows:
        want[d].append([*coder.encode_ordinary(t or ""), 50256])
    for d, own in want.items():
        got = sorted(x for _, part in sorted(pieces[d]) for x in part)
        assert got == sorted(x for ids in own for x in ids)
        if len(own) == 1:
            assert [x for _, part in sorted(pieces[d]) for x in part] == own[0]
    assert pk.pack(df.limit(0)).count() == 0


def test_query_holds_every_token(spark):
    path = "/root/testdata/sf0.001"
    coder = pk.byte_bpe()
    n = sum(len(coder.encode_ordinary(r.text)) + 1 for r in spark.read.parquet(f"{path}/documents.parquet").collect())
    rows = pk.op6_packing(spark, path).collect()
    assert sum(r.n_tokens for r in rows) == n and n / (2048 * len(rows)) > 0.97
