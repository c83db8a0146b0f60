"""N-gram Jaccard join (operator 5) with signature trees.

Documents are sets of hashed word shingles; equal sets are one node. A signature tree holds the nodes of a group: leaves
have a token bitmap and a size, inner nodes the OR of the bitmaps below and the range of the sizes, and two trees are
walked at once, leaving out pairs of tree nodes whose largest possible overlap is too small, whose sizes do not fit, or
whose members are all connected already.

Groups come from prefix tokens: two sets with Jaccard j or more share a token among the first (1 - j) of each, in any
order of all tokens. The order puts tokens of many documents last, so that groups are small unless they are similar.

1. Nodes that share their smallest token are joined first, with whole sets in the task. This connects most copies.
2. All groups of a prefix token that still hold two components are joined on bitmaps. Of the pairs left, the best one of
   each node and component is compared exactly, and then, where components remain apart, every one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import SENT_IDS, components, dealt, discard, groups, hashed_words, lists, only, ranges, rows_of, shingles, slices, store, tidy

WIDTH = 5
#: Words of 64 bits in a bitmap.
BITMAP = 32
#: Members of a group joined in one task; larger groups are split, each part with each other one.
GROUP = 2048
#: Documents from which a token counts as frequent, and frequent tokens that tasks are told of, the most frequent first.
FREQUENT, TOLD = 32, 1 << 20
#: Tokens counted in a task before counts are sent on.
COUNTED = 1 << 21
LEAF = 8
TEXT_BYTES = 2 << 20


def node_of(tokens: np.ndarray) -> int:
    """64-bit digest of a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(tokens: np.ndarray, words: int = BITMAP) -> np.ndarray:
    bits = np.zeros(words * 64, bool)
    bits[(tokens >> np.uint64(20)) % np.uint64(words * 64)] = True
    return np.packbits(bits).view(np.uint64)


def wide_bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of 8 to 16 bits for each token."""
    return bitmap(tokens, max(BITMAP, 1 << (len(tokens) // 8).bit_length()))


def may_reach(n: tuple[int, int], bits: tuple[np.ndarray, np.ndarray], percent: int) -> bool:
    """Whether two sets of such sizes and wide bitmaps may reach the percentage; the wider one is folded."""
    small, large = sorted(bits, key=len)
    small_n, large_n = n if len(bits[0]) <= len(bits[1]) else n[::-1]
    if len(large) > len(small):
        large = np.bitwise_or.reduce(large.reshape(-1, len(small)))
    overlap = -(-percent * sum(n) // (100 + percent))
    return int(_ones(small & large)) >= overlap + max(int(_ones(small)) - small_n, int(_ones(large)) - large_n)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


class Tree:
    """A complete binary signature tree over nodes ordered by size; level 0 holds the leaves."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, labels: np.ndarray, percent: int):
        self.order = np.lexsort((labels, sizes))
        n = sizes[self.order].astype(np.int64)
        bits = bitmaps[self.order]
        own = labels[self.order]
        self.percent, self.sizes, self.ones = percent, n, _ones(bits)
        # a set that reaches the percentage with another one lacks at most 1 - percent of its tokens in it
        need = self.ones - n * (100 - percent) // 100
        self.levels = [(bits, n, n, need, own, own)]
        while len(self.levels[-1][1]) > 1:
            b, low, high, need, first, last = self.levels[-1]
            if len(low) % 2:
                b, low, high, need, first, last = (np.concatenate([x, x[-1:]]) for x in (b, low, high, need, first, last))
            two = lambda x, f: f(x[::2], x[1::2])
            self.levels.append((b[::2] | b[1::2], two(low, np.minimum), two(high, np.maximum), two(need, np.minimum), two(first, np.minimum), two(last, np.maximum)))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of members that may reach the percentage and have different labels: places and common bits."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            bits, low, high, need, first, last = self.levels[level]
            keep = (100 * np.minimum(high[a], high[b]) >= self.percent * np.maximum(low[a], low[b])) & ~((first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b]))
            if not level:
                keep &= a < b
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            common = _ones(bits[a] & bits[b])
            if level:
                keep = common >= np.maximum(need[a], need[b])
            else:
                overlap = -(-self.percent * (low[a] + low[b]) // (100 + self.percent))
                keep = common >= np.maximum(self.ones[a] - low[a], self.ones[b] - low[b]) + overlap
            a, b, common = a[keep], b[keep], common[keep]
            if not level:
                if len(a):
                    yield self.order[a], self.order[b], common
                continue
            size = len(self.levels[level - 1][1])
            x = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1])
            y = np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
            keep = (x < size) & (y < size) & (x <= y)
            x, y = x[keep], y[keep]
            for i in range(0, len(x), 1 << 15):
                stack.append((level - 1, x[i : i + (1 << 15)], y[i : i + (1 << 15)]))


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the percentage."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    i = np.searchsorted(b, a)
    common = int((b[np.minimum(i, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def join_sets(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Each member of a group that is connected with a smaller one, and the smallest that it is connected with."""
    order = np.argsort(nodes, kind="stable")
    nodes, sets = nodes[order], [sets[i] for i in order]
    parent = list(range(len(nodes)))
    sizes = np.array([len(s) for s in sets])

    def meet(i: int, j: int) -> None:
        a, b = _root(parent, i), _root(parent, j)
        if a != b and similar(sets[i], sets[j], percent):
            parent[max(a, b)] = min(a, b)

    if len(nodes) > LEAF:  # members like the middle one are connected before the tree is built
        middle = int(np.argsort(sizes, kind="stable")[len(sizes) // 2])
        for i in range(len(nodes)):
            meet(middle, i)
    tree = Tree(sizes, np.stack([bitmap(s) for s in sets]), np.array([_root(parent, i) for i in range(len(nodes))]), percent)
    for a, b, _ in tree.pairs():
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            meet(i, j)
    roots = [_root(parent, i) for i in range(len(nodes))]
    return [(int(nodes[i]), int(nodes[r])) for i, r in enumerate(roots) if i != r]


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in slices(batches, most=TEXT_BYTES):
        yield part, shingles(*hashed_words(part.column("text").to_pylist()), WIDTH)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node, size and smallest token of each document, and the digest that came with its text."""
    for part, sets in _each_set(batches):
        nodes = [node_of(s) if len(s) else None for s in sets]
        first = [int(s[:1].view(np.int64)[0]) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.int64()), part.column("copy")], ["doc_id", "node", "n", "first", "copy"])


def whole_sets(docs: DataFrame, nodes: DataFrame, bits: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(node, tokens), or (node, n, bits) with a bitmap, of the nodes of a stored table (node, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _each_set(batches):
            sets = [s for s in sets if len(s)]
            ids = pa.array([node_of(s) for s in sets], pa.int64())
            if bits:
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([bits(s).tobytes() for s in sets], pa.binary())], ["node", "n", "bits"])
            else:
                for i in range(0, len(sets), 256):
                    yield pa.RecordBatch.from_arrays([ids.slice(i, 256), lists([s.view(np.int64) for s in sets[i : i + 256]], pa.int64())], ["node", "tokens"])

    found = only(docs, nodes.select("doc_id")).mapInArrow(tidy(run), "node long, n long, bits binary" if bits else "node long, tokens array<long>")
    return found


def _joined(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, "first", "part"):
        nodes = group.column("node").to_numpy()
        tokens = group.column("tokens").combine_chunks()
        values, ends = tokens.values.to_numpy().view(np.uint64), tokens.offsets.to_numpy()
        _, kept = np.unique(nodes, return_index=True)
        if len(kept) > 1:
            links = join_sets(nodes[kept], [values[ends[i] : ends[i + 1]] for i in kept], percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])


def _frequent(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Tokens (without their last 24 bits) of the lower half of all tokens, by range, with how often each occurs among COUNTED tokens."""
    held: list[np.ndarray] = []

    def counts() -> Iterator[pa.RecordBatch]:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        yield from _ranged(tokens, 39 - buckets, n)

    size = 0
    for _, sets in _each_set(batches):
        held += [s[: np.searchsorted(s, np.uint64(1 << 63))] >> np.uint64(24) for s in sets]
        size += sum(map(len, held[-len(sets) :])) if sets else 0
        if size >= COUNTED:
            yield from counts()
            held, size = [], 0
    if size:
        yield from counts()


def _buckets(parts: int) -> int:
    """Bits of the number of a range of tokens: several ranges for each of so many tasks."""
    return max(10, (4 * parts).bit_length())


def _ranged(tokens: np.ndarray, low: int, owners: tuple | np.ndarray) -> Iterator[pa.RecordBatch]:
    """Tokens by ranges, of values that differ in the lowest bits: with their counts, or with the node and size of the set that each comes from."""
    if not len(tokens):
        return
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    bucket = (tokens >> np.uint64(low)).astype(np.int64)
    held, begins = np.unique(bucket, return_index=True)
    ends = [*begins[1:], len(tokens)]
    columns: list[list] = [held.tolist(), [], [], [], []]
    for lo, hi in zip(begins, ends, strict=True):
        if isinstance(owners, np.ndarray):
            columns[1].append(np.ascontiguousarray(tokens[lo:hi, None].view(np.uint8)[:, :5]).tobytes())
            columns[2].append(owners[order[lo:hi]].astype(np.int32).tobytes())
        else:
            own = owners[0][order[lo:hi]]
            met, place = np.unique(own, return_inverse=True)
            for c, x in zip(columns[1:], (tokens[lo:hi], owners[1][met], owners[2][met].astype(np.int32), place.astype(np.int32)), strict=True):
                c.append(x.tobytes())
    names = ["bucket", "tokens", "counts"] if isinstance(owners, np.ndarray) else ["bucket", "tokens", "nodes", "sizes", "places"]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1 : len(names)])], names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, "bucket"):
        raw = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("tokens").to_pylist()]).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        values, place = np.unique(wide.view(np.uint64)[:, 0], return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, place, np.concatenate([np.frombuffer(x, np.int32) for x in group.column("counts").to_pylist()]))
        many = counts >= FREQUENT
        yield pa.RecordBatch.from_arrays([pa.array(values[many].astype(np.int64)), pa.array(counts[many].astype(np.int64))], ["token", "n"])


def _met(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The nodes that share a prefix token, for each token of two or more nodes of fitting size."""
    for group in groups(batches, "bucket"):
        rows = group.to_pydict()
        read = lambda name, kind: [np.frombuffer(x, kind) for x in rows[name]]
        tokens = np.concatenate(read("tokens", np.uint64))
        places = read("places", np.int32)
        nodes = np.concatenate([n[p] for n, p in zip(read("nodes", np.int64), places, strict=True)])
        sizes = np.concatenate([n[p] for n, p in zip(read("sizes", np.int32), places, strict=True)])
        order = np.lexsort((nodes, sizes, tokens))
        tokens, nodes, sizes = tokens[order], nodes[order], sizes[order].astype(np.int64)
        fresh = np.ones(len(tokens), bool)  # copies of a set, and equal sizes next to each other
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
        tokens, nodes, sizes = tokens[fresh], nodes[fresh], sizes[fresh]
        near = np.zeros(len(tokens) + 1, bool)
        near[1:-1] = (tokens[1:] == tokens[:-1]) & (100 * sizes[:-1] >= percent * sizes[1:])
        keep = near[1:] | near[:-1]
        # a run of fitting neighbours of one token is a list of its own
        starts = np.flatnonzero(keep & ~near[:-1])
        ends = np.flatnonzero(keep & ~near[1:]) + 1
        found = {tuple(np.sort(nodes[a:b]).tolist()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}
        for some in [list(found)[i : i + 4096] for i in range(0, len(found), 4096)]:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.int64()))], ["nodes"])


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Of rows ordered by all keys, the last one first, where the first of those that agree in the first two is."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    a, b = keys[0][order], keys[1][order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new]


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, each: str) -> Iterator[pa.RecordBatch]:
    """Pairs of a group that its signature tree leaves: all, or that with the largest share of common bits for each two components, or for each node and component."""
    for group in groups(batches, "list", "part"):
        nodes, labels, sizes = (group.column(c).to_numpy() for c in ("node", "label", "n"))
        bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(-1, BITMAP)
        out: list[list[np.ndarray]] = [[], [], []]
        for a, b, common in Tree(sizes, bits, labels, percent).pairs():
            share = -(1000 * common // np.maximum(sizes[a], sizes[b]))
            la, lb = labels[a], labels[b]
            if each == "components":
                k = [_firsts(np.minimum(la, lb), np.maximum(la, lb), share, nodes[a], nodes[b])]
                ends = [(a, b)]
            elif each == "nodes":
                ends = [(a, b), (b, a)]
                k = [_firsts(x, labels[y], share, nodes[y]) for x, y in ends]
            else:
                k, ends = [slice(None)], [(a, b)]
            for pick, (x, y) in zip(k, ends, strict=True):
                for o, v in zip(out, (nodes[x], nodes[y], share), strict=True):
                    o.append(v[pick])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], ["a", "b", "share"])


def _reaching(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose wide bitmaps leave them."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True)
        keep = [may_reach((n, m), (np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), percent) for n, m, x, y in rows]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _connected(docs: DataFrame, owners: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that reach the percentage, compared exactly."""
    ends = lambda p: store(p.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(owners, "node"), "nodes")
    nodes = ends(pairs)
    wide = store(whole_sets(docs, nodes, wide_bitmap).dropDuplicates(["node"]), "wide")
    drawn = pairs.join(wide.toDF("a", "n", "x"), "a").join(wide.toDF("b", "m", "y"), "b")
    left = store(drawn.mapInArrow(tidy(lambda b: _reaching(b, percent)), "a long, b long"), "reaching")
    discard(nodes, wide)
    nodes = ends(left)
    sets = store(whole_sets(docs, nodes).groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")
    both = left.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = store(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
    discard(nodes, left, sets)
    return links


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after the components that links (a, b) of nodes connect have become one."""
    ends = links.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = components(ends)
    out = store(labels.join(joined.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    discard(labels, links)
    return out


def parts_of(held: DataFrame) -> DataFrame:
    """held (list, members, node, label), each row for each ``part`` of its list that its node is compared in.

    A list of up to GROUP members is one part. The members of a larger one are dealt into bins by component, a component
    of more than GROUP of them into bins of its own, and a part is two bins, or one of several components: bins of
    one component do not meet, so a component's members are repeated for the bins of the others only.
    """
    small = held.where(F.col("members") <= GROUP).select("list", F.lit(0).cast("long").alias("part"), "node", "label")
    large = held.where(F.col("members") > GROUP)
    if large.isEmpty():
        return small
    big = store(large.groupBy("list", "label").agg(F.count("*").alias("own")).where(F.col("own") > GROUP), "big")
    within = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("label"), F.ceil(F.col("members") / GROUP))).otherwise(F.xxhash64("label", F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / GROUP))))
    dealt_ = store(large.join(big, ["list", "label"], "left").select("list", "node", "label", within.alias("bin"), F.when(F.col("own").isNotNull(), F.col("label")).alias("single")), "bins")
    bins = store(dealt_.groupBy("list").agg(F.collect_set(F.struct("bin", "single")).alias("bins")), "lists")
    meets = F.filter("bins", lambda b: b["single"].isNull() | F.col("single").isNull() | (b["single"] != F.col("single")))
    part = F.xxhash64(F.least("bin", "other"), F.greatest("bin", "other"))
    met = dealt_.join(bins, "list").select("list", "node", "label", "bin", F.explode(F.transform(meets, lambda b: b["bin"])).alias("other"))
    return small.unionByName(met.select("list", part.alias("part"), "node", "label"))


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and copy (xxhash64 of the text) of each row of docs.

    Two documents link if their sets of 5-word shingles (a shorter text is one shingle) have a Jaccard similarity of
    percent or more; component_id is the smallest doc_id that links lead to. Every link counts; shingles are compared
    by 64-bit hashes. A text without words, or null, links with nothing and is its own component. A row with a null
    id links with nothing and has a null component. Rows that repeat an id are judged by their own texts, which copy
    tells apart.
    """
    spark = docs.sparkSession
    docs = rows_of(docs, id_col, text_col)
    described = store(docs.withColumn("copy", F.xxhash64("text")).mapInArrow(tidy(describe), "doc_id long, node long, n long, first long, copy long"), "described")
    known = described.where("node IS NOT NULL AND doc_id IS NOT NULL")
    owners = store(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("first").alias("first")), "owners")
    named = owners.select("node", "doc_id")
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")

    # 1. nodes with the same smallest token
    heads = owners.groupBy("first").agg(F.count("*").alias("members")).where("members > 1")
    heads = store(heads, "heads")
    met = store(owners.join(heads, "first", "left_semi").select("doc_id"), "met")
    large = store(heads.where(F.col("members") > GROUP), "large")
    sets = whole_sets(docs, met).withColumn("first", F.get("tokens", F.lit(0)))
    sets = sets.join(F.broadcast(large) if large.count() <= SENT_IDS else large, "first", "left")
    parts = F.ceil(F.coalesce("members", F.lit(1)) / GROUP)
    sets = sets.select("first", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", "tokens")
    links = store(dealt(sets, "first", "part").mapInArrow(tidy(lambda b: _joined(b, percent)), "a long, b long"), "links")
    labels = store(owners.select("node").join(components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    discard(heads, met, large, links)

    # 2. nodes with a common prefix token
    n_tokens = owners.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    few, many = ranges(spark, n_tokens * 5 // 2), ranges(spark, n_tokens * 5)
    counted = docs.mapInArrow(tidy(lambda b: _frequent(b, _buckets(few))), "bucket int, tokens binary, counts binary").repartition(few, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_counted), "token long, n long")
    told = counted.orderBy(F.desc("n"), "token").limit(TOLD).select("token").toPandas()["token"].to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(told.astype(np.uint64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for _, sets in _each_set(batches):
            sets = [s for s in sets if len(s)]
            if not sets:
                continue
            n = np.array([len(s) for s in sets])
            tokens = np.concatenate(sets)
            short = tokens >> np.uint64(24)
            place = np.searchsorted(late, short)
            often = (late[np.minimum(place, len(late) - 1)] == short) if len(late) else np.zeros(len(tokens), bool)
            owner = np.repeat(np.arange(len(sets)), n)
            order = np.lexsort((often, owner))  # stable: frequent tokens last, each kind by value
            rank = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
            kept = order[rank <= (n - -(-percent * n // 100))[owner]]
            yield from _ranged(tokens[kept], 64 - _buckets(many), (owner[kept], np.array([node_of(s) for s in sets], np.int64), n))

    shared = docs.mapInArrow(tidy(prefixes), "bucket int, tokens binary, nodes binary, sizes binary, places binary").repartition(many, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(lambda b: _met(b, percent)), "nodes array<long>")
    member = store(shared.distinct().select(F.xxhash64("nodes").alias("list"), F.size("nodes").alias("members"), F.explode("nodes").alias("node")), "members")
    tested = None
    for each in ("components", "nodes", "all"):
        several = labels.groupBy("label").agg((F.count("*") > 1).alias("several"))
        held = member.join(labels.join(several, "label"), "node")
        mixed = held.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("several").alias("several")).where("low < high")
        if each != "components":  # components of one node have been compared
            mixed = mixed.where("several")
        mixed, held = store(mixed.select("list"), "mixed"), held.drop("several")  # a table of its own: a skewed side of the join can then be split
        held = store(held.join(mixed, "list"), "held")
        nodes = store(held.select("node").distinct().join(named, "node"), "nodes")
        bits = whole_sets(docs, nodes, bitmap).dropDuplicates(["node"])
        split = parts_of(held).join(bits, "node").select("list", "part", "node", "label", "n", "bits")
        pairs = dealt(split, "list", "part").mapInArrow(tidy(lambda b, each=each: _candidates(b, percent, each)), "a long, b long, share long")
        if each != "all":
            pairs = pairs.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
            keys = [F.least("la", "lb"), F.greatest("la", "lb")] if each == "components" else ["a", "lb"]
            pairs = pairs.groupBy(*keys).agg(F.min(F.struct("share", "a", "b")).alias("p")).select("p.*")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = store(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        if pairs.isEmpty() and each != "components":
            continue  # the best pairs may all be tested, and others not
        labels = _relabel(labels, _connected(docs, named, pairs, percent))
        discard(mixed, held, nodes)

    smallest = owners.join(labels, "node").groupBy("label").agg(F.min("doc_id").alias("component"))
    found = store(labels.join(smallest, "label").select("node", "component"), "found")
    discard(owners, labels, member)
    frequent.unpersist()
    return described.join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), "copy")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copy")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
walk AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT walk.doc_id, e.b FROM walk JOIN e ON walk.other = e.a),
m AS (SELECT doc_id, min(other) AS component_id FROM walk GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON w.doc_id = m.doc_id
"""
