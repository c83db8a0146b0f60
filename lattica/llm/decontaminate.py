"""Benchmark decontamination (operator 1) with a distributed positional inverted index.

``build_index`` writes the postings of every term of the training texts, one row for each segment of about 8 MB of text,
once for any number of test sets. A segment is a whole index of its own documents, so a phrase is found inside one
segment: ``search`` sends the test phrases to the segments, a block at a time, and moves no posting through a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_schema, rows_of, slices, store, tidy

#: Bytes to blanks (all but 0-9, a-z and what is not ASCII), and A-Z to a-z.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Test texts sent to the tasks at once; more of them are searched in as many passes over the stored index.
BLOCK_BYTES = 2 << 20
#: Starts looked up at once in a segment.
LOOKED = 1 << 18

INDEX = "doc_id array<bigint>, copy array<bigint>, n_words array<bigint>, terms array<binary>, counts binary, positions binary"
MATCHES = "doc_id bigint, copy bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>, near array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def split_words(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one text after another, and how many each has."""
    data = np.frombuffer((b" ".join([t or b"" for t in texts]) + b" ").translate(TABLE), np.uint8)
    letter = data != 32
    ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    lengths = np.cumsum(letter, dtype=np.int64)[ends - 1]  # letters up to the end of each word
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, lengths)), pa.py_buffer(data[letter])])
    bounds = np.cumsum([len(t or b"") + 1 for t in texts])
    return words, np.diff(np.searchsorted(ends, bounds), prepend=0)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored positional index of docs: for each segment its rows, its terms, and the postings of each term in order."""
    schema = arrow_schema(INDEX)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, n_words = split_words(part.column("text").to_pylist())
            coded = words.dictionary_encode()
            ids = coded.indices.to_numpy()
            postings = np.argsort(ids, kind="stable").astype(np.int32)
            counts = np.bincount(ids, minlength=len(coded.dictionary)).astype(np.int32)
            row = [part.column("doc_id").to_pylist(), part.column("copy").to_pylist(), n_words, coded.dictionary.to_pylist(), counts.tobytes(), postings.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return store(rows_of(docs, id_col, text_col).withColumn("copy", F.xxhash64("text")).mapInArrow(tidy(build), INDEX), "postings", large_rows=True)


class Segment:
    """One row of the index, with the postings of the given terms."""

    def __init__(self, row: dict, terms: pa.Array):
        self.n_words = row["n_words"].values.to_numpy()
        self.ends = np.cumsum(self.n_words)
        counts = np.frombuffer(row["counts"].as_py(), np.int32)
        held = row["terms"].values.cast(pa.binary())
        at = pc.fill_null(pc.index_in(terms, value_set=held), -1).to_numpy()
        known = np.flatnonzero(at >= 0)
        #: How often each term occurs; the last entry stands for no term.
        self.counts = np.zeros(len(terms) + 1, np.int64)
        self.counts[known] = counts[at[known]]
        self.begins = np.cumsum(self.counts) - self.counts
        positions, ends = np.frombuffer(row["positions"].as_py(), np.int32), np.cumsum(counts, dtype=np.int64)
        picked = [positions[ends[i] - counts[i] : ends[i]] for i in at[known].tolist()]
        self.positions = np.concatenate(picked).astype(np.int64) if picked else np.zeros(0, np.int64)
        #: All postings as one ordered list: the term's number above the position.
        self.keys = np.repeat(known, self.counts[known]) << 32 | self.positions

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, "right")

    def meet(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term occurs between low and high, both included."""
        i = np.searchsorted(self.keys, terms << 32 | np.maximum(low, 0))
        return (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] <= (terms << 32 | np.maximum(high, 0))) & (high >= low)


class Phrases:
    """The distinct windows of one block of test texts, as rows of term numbers."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - width + 1) if words else 0):
                owners[tuple(words[i : i + width])].add(item)
        numbers = {t: i for i, t in enumerate(sorted({t for w in owners for t in w}))}
        self.terms = pa.array(list(numbers), pa.binary())
        self.sizes = np.array([len(w) for w in owners], np.int64)
        self.words = np.full((len(owners), width), -1, np.int64)
        for i, w in enumerate(owners):
            self.words[i, : len(w)] = [numbers[t] for t in w]
        self.owners = [sorted(x) for x in owners.values()]

    def found(self, segment: Segment, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows that occur in a document: the window, its start, which may lie before the document if there is a slop, and the document.

        From the postings of its rarest term on, shifted by the term's place in the window, each further list is
        intersected. A window occurs at a start if each word has a place at most ``slop`` from its own, all in one
        document.
        """
        known = np.flatnonzero(np.where(self.words >= 0, segment.counts[self.words], 1).min(axis=1) > 0) if len(self.words) else []
        if not len(known):
            return
        rarity = np.where(self.words[known] >= 0, segment.counts[self.words[known]], np.iinfo(np.int64).max)
        order = np.argsort(rarity, axis=1, kind="stable")
        rarest = self.words[known, order[:, 0]]
        counts, shifts = segment.counts[rarest], np.arange(-slop, slop + 1)
        ends = np.cumsum(counts)
        for first in range(0, int(ends[-1]), LOOKED // len(shifts)):
            nth = np.arange(first, min(first + LOOKED // len(shifts), int(ends[-1])))
            row = np.searchsorted(ends, nth, "right")
            at = segment.positions[segment.begins[rarest[row]] + nth - (ends[row] - counts[row])]
            doc = np.repeat(segment.documents(at), len(shifts))
            start = (at - order[row, 0])[:, None] + shifts
            row, start = np.repeat(row, len(shifts)), start.ravel()
            for k in range(1, self.words.shape[1]):
                place = order[row, k]
                term = self.words[known[row], place]
                low = np.maximum(start + place - slop, segment.ends[doc] - segment.n_words[doc])
                high = np.minimum(start + place + slop, segment.ends[doc] - 1)
                keep = (term < 0) | segment.meet(np.maximum(term, 0), low, high)
                row, start, doc = row[keep], start[keep], doc[keep]
            yield known[row], start, doc


def _search(index: DataFrame, phrases: Phrases, slop: int) -> DataFrame:
    schema, names, shared = arrow_schema(MATCHES), index.columns, index.sparkSession.sparkContext.broadcast(phrases)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                row = {f: batch.column(f)[r] for f in names}
                segment = Segment(row, own.terms)
                edge = np.zeros(int(segment.ends[-1]) + 1, np.int32)
                items, near, spans = defaultdict(set), defaultdict(set), defaultdict(list)

                def note(into: dict, windows: np.ndarray, docs: np.ndarray) -> None:
                    for w, d in np.unique(np.stack([windows, docs]), axis=1).T.tolist():
                        into[d].update(own.owners[w])

                for windows, starts, docs in own.found(segment, 0):
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + own.sizes[windows], -1)
                    note(items, windows, docs)
                if slop:
                    for windows, _, docs in own.found(segment, slop):
                        note(near, windows, docs)
                change = np.diff(np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]]).astype(np.int8))
                for lo, hi in zip(np.flatnonzero(change > 0).tolist(), np.flatnonzero(change < 0).tolist(), strict=True):
                    while lo < hi:  # hit words that go on in the next document are cut there
                        d = int(segment.documents(lo))
                        begin, end = int(segment.ends[d] - segment.n_words[d]), min(hi, int(segment.ends[d]))
                        spans[d].append({"start": lo - begin, "end": end - begin})
                        lo = end
                n = len(segment.n_words)
                columns = [row["doc_id"].values, row["copy"].values, row["n_words"].values, [spans[d] for d in range(n)], [sorted(items[d]) for d in range(n)], [sorted(near[d] - items[d]) for d in range(n)]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return index.mapInArrow(tidy(look), MATCHES)


def search(docs: DataFrame, items: DataFrame, width: int = 13, slop: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Phrase and proximity matches of the items' windows of width words in docs.

    Returns for each row of docs: doc_id, n_words, ``spans`` (word ranges inside exact matches), ``items``
    (ids with an exact match, as strings) and ``near`` (ids without one, that have a window and a place for it, which
    may begin before the text, at most slop words from which the text has each of its words). An item of fewer words
    than width is one window.

    Items are searched in blocks of about BLOCK_BYTES, each against the whole stored index, so what a task is sent stays
    bounded however many items there are. Null or empty texts have no words; items without id or words match nothing;
    each repeated row gets its own result; a text longer than a segment's 8 MB is a segment of its own.
    """
    if slop < 0:
        raise ValueError("slop is negative")
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").cast("binary").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item") + 64), F.lit(0))).first()[0]
    blocks = -(-n_bytes // BLOCK_BYTES) or 1
    index = build_index(docs, id_col, text_col)
    found = None
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        phrases = Phrases([(r.item, bytes(r.text)) for r in block.collect()], width)
        part = _search(index, phrases, slop)
        found = part if found is None else found.unionByName(store(part, "matches"))
    if blocks > 1:  # each row of docs has a row from each block; repeated rows have the same content
        merged = [F.flatten(F.collect_list("spans")).alias("spans"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near"))]
        found = found.groupBy("doc_id", "copy", "n_words").agg(F.count("*").alias("rows"), *merged)
        found = found.withColumns({"near": F.array_except("near", "items"), "rows": F.explode(F.sequence(F.lit(1), F.expr(f"rows div {blocks}")))})
    return found.select("doc_id", "n_words", "spans", "items", "near")


def n_covered(spans: Column) -> Column:
    """The words inside the union of spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``search`` with n_hit (words inside an exact match) and contaminated (a twentieth of the words or more are)."""
    found = search(docs, items, **options).withColumn("n_hit", n_covered(F.col("spans")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows, the items met, and those met by proximity alone, for each document."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated", F.array_join(F.array_sort("near"), ",").alias("near_items"))


OP1_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
il AS (SELECT item, w, least(len(w), 13) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM il),
dl AS (
  SELECT doc_id, w, s.n, unnest(generate_series(1, len(w) - s.n + 1)) AS i
  FROM dw JOIN (SELECT DISTINCT n FROM win) s ON len(w) >= s.n),
dg AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM dl),
hit AS (SELECT doc_id, i, dg.n, item FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
dp AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM dw),
wn AS (SELECT row_number() OVER () AS win, item, n, ws FROM (SELECT DISTINCT item, n, w[i:i + n - 1] AS ws FROM il)),
wt AS (SELECT win, item, n, unnest(ws) AS t, generate_subscripts(ws, 1) AS k FROM wn),
often AS (SELECT t, count(*) AS c FROM dp GROUP BY t),
anchor AS (SELECT win, arg_min(t, coalesce(c, 0)) AS t, arg_min(k, coalesce(c, 0)) AS k FROM wt LEFT JOIN often USING (t) GROUP BY win),
cand AS (SELECT DISTINCT doc_id, win, p - k + d AS s FROM anchor JOIN dp USING (t) CROSS JOIN (SELECT unnest(generate_series(-2, 2)) AS d)),
close AS (
  SELECT DISTINCT doc_id, item
  FROM (SELECT cand.doc_id, item, cand.win, s, n, count(DISTINCT wt.k) AS m
        FROM cand JOIN wt ON cand.win = wt.win JOIN dp ON dp.doc_id = cand.doc_id AND dp.t = wt.t AND dp.p BETWEEN s + wt.k - 2 AND s + wt.k + 2
        GROUP BY cand.doc_id, item, cand.win, s, n) WHERE m = n),
near AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT * FROM close EXCEPT SELECT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(met.items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(near.items, '') AS near_items
FROM dw LEFT JOIN covered ON dw.doc_id = covered.doc_id LEFT JOIN met ON dw.doc_id = met.doc_id LEFT JOIN near ON dw.doc_id = near.doc_id
"""
