"""MinHash near-dedup (operator 13): bands of minima give candidates, packed low bits of the minima estimate, whole sets confirm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import components, dealt, discard, groups, hashed_words, lists, mix, only, rows_of, shingles, slices, store, tidy
from lattica.llm.jaccard import bitmap, parts_of

WIDTH = 4
#: Minima of a band, and low bits kept of each minimum.
ROWS, BITS = 4, 2
#: Chance that a pair at the threshold shares no band, and that its low bits fall below the estimate asked for.
MISSED = 1e-9
TEXT_BYTES = 2 << 20
#: Members of one group compared with all others at once, and pairs of wide bitmaps.
BLOCK, PAIRS = 128, 4096
#: Words of 64 bits in the smallest and the largest wide bitmap.
LEAST_WIDE, MOST_WIDE = 32, 1024


def bands_of(percent: int) -> int:
    """Bands, a multiple of 8, of which a pair at the threshold shares one but for a chance of MISSED."""
    return -(-ceil(log(MISSED) / log(1 - (percent / 100) ** ROWS)) // 8) * 8


def most_apart(percent: int, slots: int) -> int:
    """How many slots of low bits of a pair at the threshold differ at most, but for a chance of MISSED.

    Two minima agree with probability J, and low bits of different minima with 2 to the -BITS, so a slot differs with
    probability (1 - J)(1 - 2 to the -BITS).
    """
    p = (1 - percent / 100) * (1 - 2.0**-BITS)
    left, k = 1.0, -1
    while left > MISSED and k < slots:
        k += 1
        left -= comb(slots, k) * p**k * (1 - p) ** (slots - k)
    return k


def factors(slots: int) -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a mask for each slot: fixed, so that signatures of separate runs can be compared."""
    seeds = mix(np.arange(1, 2 * slots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:slots] | np.uint64(1), seeds[slots:]


def minima(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """The least hash of each non-empty set, for each slot."""
    out = np.empty((len(sets), slots), np.uint64)
    if not sets:
        return out
    tokens = np.concatenate(sets)
    begins = np.cumsum([0, *(len(s) for s in sets[:-1])])
    hashed = np.empty_like(tokens)
    for slot, (factor, mask) in enumerate(zip(*factors(slots), strict=True)):
        np.bitwise_xor(tokens, mask, out=hashed)
        np.multiply(hashed, factor, out=hashed)
        out[:, slot] = np.minimum.reduceat(hashed, begins)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of minima, one plane of bits for each of them, as bytes."""
    return np.concatenate([np.packbits(((least >> np.uint64(b)) & np.uint64(1)).astype(bool), axis=1) for b in range(BITS)], axis=1)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many slots packed signatures differ: bits of all planes OR-combined, and counted."""
    differ = x ^ y
    planes = np.bitwise_or.reduce(differ.reshape(*differ.shape[:-1], BITS, -1), axis=-2)
    return np.bitwise_count(planes).sum(axis=-1, dtype=np.int64)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jaccard similarity estimated from packed signatures, corrected for low bits that agree by chance."""
    chance = 2.0**-BITS
    agree = 1 - apart(x, y) / (x.shape[-1] * 8 // BITS)
    return (agree - chance) / (1 - chance)


def _sets(part: pa.RecordBatch) -> list[np.ndarray]:
    return shingles(*hashed_words(part.column("text").to_pylist()), WIDTH)


def signed(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, h1, h2, n, bands, bits) of docs (doc_id, text as bytes): digest and size of each row's set, and, if it is not empty, its band keys and low bits."""
    bands = bands_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = factors(ROWS)[0]
        for part in slices(batches, most=TEXT_BYTES):
            sets = _sets(part)
            full = [i for i, s in enumerate(sets) if len(s)]
            least = minima([sets[i] for i in full], bands * ROWS)
            keys = mix((least.reshape(len(full), bands, ROWS) * weights).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)
            place = pa.array([None if not len(s) else at for s, at in zip(sets, np.cumsum([len(s) > 0 for s in sets]) - 1, strict=True)], pa.int64())
            digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            bits = pa.array([row.tobytes() for row in packed(least)], pa.binary())
            columns = [part.column("doc_id"), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([len(s) for s in sets], pa.int64()), lists(list(keys), pa.int64()).take(place), bits.take(place)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h1", "h2", "n", "bands", "bits"])

    return docs.mapInArrow(tidy(run), "doc_id long, h1 long, h2 long, n long, bands array<long>, bits binary")


def _matching(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with the low bits x and y whose estimates reach."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
        yield batch.select(["a", "b"]).filter(pa.array(apart(x, y) <= most))


def wide_bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of 8 to 16 bits for each token, within bounds; a power of two, so that it can be folded."""
    return bitmap(tokens, min(max(LEAST_WIDE, 1 << (len(tokens) // 8).bit_length()), MOST_WIDE))


def folded(wide: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Wide bitmaps of at least so many bytes folded to that size, those of fewer left empty, and their bits."""
    out = np.zeros((len(wide), size // 8), np.uint64)
    for i, w in enumerate(wide):
        if len(w) >= size:
            out[i] = np.bitwise_or.reduce(np.frombuffer(w, np.uint64).reshape(-1, size // 8))
    return out, np.bitwise_count(out).sum(axis=1, dtype=np.int64)


class Wide:
    """Which pairs of a group's members may reach the percentage: common tokens leave common bits, but for those that fall together."""

    def __init__(self, wide: list[bytes], n: np.ndarray, percent: int):
        self.wide, self.n, self.percent = wide, n, percent
        self.sizes = np.array([len(w) for w in wide])
        self.of_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def may_reach(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        size = np.minimum(self.sizes[a], self.sizes[b])
        need = -(-self.percent * (self.n[a] + self.n[b]) // (100 + self.percent))
        for s in np.unique(size).tolist():
            if s not in self.of_size:
                self.of_size[s] = folded(self.wide, s)
            bits, ones = self.of_size[s]
            at = np.flatnonzero(size == s)
            for i in range(0, len(at), PAIRS):
                some = at[i : i + PAIRS]
                x, y = a[some], b[some]
                common = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
                out[some] = common >= need[some] + np.maximum(ones[x] - self.n[x], ones[y] - self.n[y])
        return out


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, most: int, each: str) -> Iterator[pa.RecordBatch]:
    """Pairs of a band's members in different components whose sizes fit, whose estimates reach and whose wide bitmaps allow it: all, or of each two components the nearest."""
    for group in groups(batches, "list", "part"):
        node, label, n = (group.column(c).to_numpy() for c in ("node", "label", "n"))
        order = np.lexsort((node, n))
        node, label, n = node[order], label[order], n[order]
        bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint8).reshape(len(node), -1)[order]
        bits = bits.view(np.uint32) if bits.shape[1] % (4 * BITS) == 0 else bits
        raw = group.column("wide").to_pylist()
        wide = Wide([raw[i] for i in order.tolist()], n, percent)
        ends = np.searchsorted(n, n * 100 // percent, side="right")
        for i in range(0, len(node), BLOCK):
            stop = int(ends[min(i + BLOCK, len(node)) - 1])
            far = apart(bits[i : i + BLOCK, None], bits[None, i:stop])
            at, other = np.nonzero((far <= most) & (label[i : i + BLOCK, None] != label[None, i:stop]))
            keep = (other > at) & (other + i < ends[at + i])
            at, other = at[keep], other[keep]
            keep = wide.may_reach(at + i, other + i)
            at, other = at[keep], other[keep]
            far = far[at, other]
            a, b = node[at + i], node[other + i]
            if each == "components":
                la, lb = label[at + i], label[other + i]
                low, high = np.minimum(la, lb), np.maximum(la, lb)
                pick = np.lexsort((b, a, far, high, low))
                new = np.ones(len(pick), bool)
                new[1:] = (low[pick][1:] != low[pick][:-1]) | (high[pick][1:] != high[pick][:-1])
                a, b, far = a[pick[new]], b[pick[new]], far[pick[new]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(far)], ["a", "b", "far"])


def widened(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, wide), the wide bitmaps of the ids of a stored table (doc_id); docs as ``rows_of`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=TEXT_BYTES):
            sets = _sets(part)
            full = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(full, pa.int64())), pa.array([wide_bitmap(sets[i]).tobytes() for i in full], pa.binary())], ["node", "wide"])

    return only(docs, ids).mapInArrow(tidy(run), "node long, wide binary")


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose whole sets reach the percentage; docs as ``rows_of`` gives them, pairs stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=TEXT_BYTES):
            sets = _sets(part)
            for i in range(0, len(sets), 256):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(i, 256), lists([s.view(np.int64) for s in sets[i : i + 256]], pa.int64())], ["node", "tokens"])

    ids = store(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = store(only(docs, ids).mapInArrow(tidy(run), "node long, tokens array<long>"), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = store(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct(), "links")
    discard(ids, sets)
    return links


def minhash_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs.

    Two documents link if their sets of 4-word shingles (a shorter text is one shingle) have a Jaccard similarity of
    percent or more, by whole sets of 64-bit hashes; component_id is the smallest doc_id that links lead to, and kept
    says that it is the document's own.

    1. A set's least hashes under fixed functions, four to a band: sets at the threshold share one of the bands but for
       a chance of 10 to the -9. Equal sets, by 128-bit digests, are one node, named by its smallest id.
    2. In each band, the smallest node is a candidate for each other member. The low two bits of each minimum, packed in
       planes, estimate the similarity by a count of differing bits, corrected for chance; what falls short of the
       threshold by six deviations is left out, and whole sets decide.
    3. Bands that still hold two components give their other pairs: first the nearest of two components, then all that
       are left. Before a pair goes on, wide bitmaps of whole sets bound what it can share, so that groups of texts somewhat
       alike, which fall short of the threshold, send few. Bands of over 2048 nodes are dealt to several tasks.

    A text without words, or null, links with nothing. A row with a null id links with nothing, has a null component
    and is kept. Rows that repeat an id are one document of several texts: each has its own n_shingles, and links
    of any of them are the document's. Other columns are left out.
    """
    docs = rows_of(docs, id_col, text_col)
    bands = bands_of(percent)
    most = most_apart(percent, bands * ROWS)
    described = store(signed(docs, percent), "signed")
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    known = described.where("n > 0 AND doc_id IS NOT NULL")
    firsts = [F.first(c).alias(c) for c in ("n", "bands", "bits")]
    nodes = store(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), *firsts), "nodes")
    copies = nodes.where("node < last").select("h1", "h2", "node")

    # 1. ids of several texts, which belong to several nodes
    own = known.select("doc_id", "h1", "h2").join(copies, ["h1", "h2"], "left").select("doc_id", F.coalesce("node", "doc_id").alias("node"))
    several = own.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("doc_id")
    same = store(own.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(), "same")

    # 2. the smallest node of each band and the others
    rows = nodes.select("node", F.explode("bands").alias("list"))
    shared = store(rows.groupBy("list").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("members")).where("first < last").drop("last"), "bands")
    rows = store(rows.join(shared, "list").select("list", "members", "first", "node"), "members")
    discard(shared)
    signs = nodes.select("node", "n", "bits")
    pairs = rows.where("first < node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(signs.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("n").alias("n")), "a").join(signs.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m")), "b")
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    tested = store(pairs.where(fits).mapInArrow(tidy(lambda b: _matching(b, most)), "a long, b long").distinct(), "pairs")
    links = confirmed(docs, tested, percent)
    labels = store(components(links.union(same)), "labels")
    discard(links, same)

    # 3. what two components of a band are left to compare
    held_rows = rows.select("list", "members", "node")
    for each in ("components", "all"):
        held = held_rows.join(labels, "node", "left").select("list", "members", "node", F.coalesce("label", "node").alias("label"))
        mixed = store(held.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("list"), "mixed")
        held = store(held.join(mixed, "list"), "held")
        ids = store(held.select(F.col("node").alias("doc_id")).distinct(), "ids")
        wide = store(signs.join(widened(docs, ids), "node"), "wide")
        split = parts_of(held).join(wide, "node").select("list", "part", "node", "label", "n", "bits", "wide")
        pairs = dealt(split, "list", "part").mapInArrow(tidy(lambda b, each=each: _candidates(b, percent, most, each)), "a long, b long, far long")
        if each == "components":
            named = held.select("node", "label").distinct()
            pairs = pairs.join(named.toDF("a", "la"), "a").join(named.toDF("b", "lb"), "b")
            pairs = pairs.groupBy(F.least("la", "lb"), F.greatest("la", "lb")).agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b")
        pairs = store(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(pairs)
        links = confirmed(docs, pairs, percent)
        if not links.isEmpty():
            before, labels = labels, store(components(labels.toDF("a", "b").union(links)), "labels")
            discard(before)
        discard(mixed, held, ids, wide, links)
    discard(rows)

    found = nodes.select("h1", "h2", "node", "last").join(labels, "node", "left").where("label IS NOT NULL OR node < last").select("h1", "h2", F.coalesce("label", "node").alias("component"))
    found = store(found, "found")
    out = described.select("doc_id", "h1", "h2", "n").join(found, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op13_minhash(spark, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document."""
    return minhash_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
walk AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT walk.doc_id, e.b FROM walk JOIN e ON walk.other = e.a),
m AS (SELECT doc_id, min(other) AS component_id FROM walk GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON w.doc_id = m.doc_id
"""
