import random

import numpy as np
import pyarrow as pa
from lattica.llm import common
from lattica.llm.decontaminate import TABLE, words_of


def test_hashed_words():
    r = random.Random(0)
    texts = [None, b"", b" ", b"One", b" one\ttwo  ONE\n", "é ß one".encode(), b"x" * 3000, *(bytes(r.choice(b"ab \n.") for _ in range(r.randrange(60))) for _ in range(300))]
    seen = {}
    for table, words in ((None, lambda t: (t or b"").lower().split()), (TABLE, words_of)):
        for some in (texts, texts[::-1], texts[5:9]):
            hashes, counts = common.hashed_words(some, table)
            assert counts.tolist() == [len(words(t)) for t in some]
            for h, w in zip(hashes.tolist(), [w for t in some for w in words(t)], strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_groups_cross_batches():
    keys = [1, 1, 2, 2, 2, 3, 5, 5]
    for cut in range(9):
        batches = [pa.record_batch({"k": pa.array(keys[:cut], pa.int64()), "v": pa.array(range(cut), pa.int64())}), pa.record_batch({"k": pa.array(keys[cut:], pa.int64()), "v": pa.array(range(cut, 8), pa.int64())})]
        got = [(g.column("k")[0].as_py(), g.column("v").to_pylist()) for g in common.groups(batches, "k")]
        assert got == [(1, [0, 1]), (2, [2, 3, 4]), (3, [5]), (5, [6, 7])]


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(50)] + [(-5, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.label for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slices():
    batch = pa.record_batch({"text": pa.array([b"aa", None, b"bbbbbb", b"c", b"", b"d"], pa.binary())})
    got = [x.column("text").to_pylist() for x in common.slices([batch], most=3)]
    assert got == [[b"aa", None], [b"bbbbbb"], [b"c", b"", b"d"]]
    assert np.array_equal(common.mix(np.arange(4, dtype=np.uint64)), common.mix(np.arange(4, dtype=np.uint64)))


def test_hashes_do_not_depend_on_blocks():
    r = random.Random(5)
    words = ["".join(r.choice("abcÉ") for _ in range(r.randrange(1, 9))) for _ in range(300_000)]
    words[1000] = "y" * (3 * common.BLOCK + 17)
    words[2000] = "y" * common.BLOCK
    words[-1] = "z" * (common.BLOCK + 1)
    text = "  ".join(words).encode()
    assert len(text) > 5 * common.BLOCK
    hashes, counts = common.hashed_words([b"a b", text, None, b"c"])
    alone = [common.hashed_words([w.encode()])[0][0] for w in ("a", "b", *words[:50], words[1000], words[2000], words[2001])]
    assert counts.tolist() == [2, 300_000, 0, 1]
    assert hashes[:52].tolist() == [int(x) for x in alone[:52]] and hashes[[1002, 2002, 2003]].tolist() == [int(x) for x in alone[52:]]
    assert hashes[300_001] == common.hashed_words([words[-1].encode()])[0][0] and len(set(hashes.tolist())) == len({*words, "a", "b", "c"})
