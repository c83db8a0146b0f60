"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lattica.sources.shared import LARGE_ROWS, discard, shared_dir, stored

#: Text handled at once inside a task; a longer text is handled alone.
SLICE_BYTES = 8 << 20


#: Bytes of an Arrow batch: texts are large rows, and a task holds a few batches outside the heap.
BATCH_BYTES = 4 << 20


def store(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """df, written to the shared folder, in small blocks if its rows are large, and read again: cuts the lineage, and survives the loss of executors."""
    return stored(df, name, **LARGE_ROWS if large_rows else {})


def arrow_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_BYTES; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.match(r"-?[0-9]+", spark.conf.get(key))[0])
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows, after whose last batch the worker, which goes on to other tasks, gives the memory back that it needs no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text's UTF-8 bytes, under fixed names; other columns, whatever their names, are left out."""
    arrow_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def remainder(column: Column, of: int) -> Column:
    """crc32 of the value as text, modulo of; null for null."""
    return F.crc32(column.cast("string")) % of


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema; for the driver, which has a session to parse it with."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose column holds at most so many bytes, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > begin and total + size > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        if batch.num_rows > begin:
            yield batch.slice(begin)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Multiplier of the polynomial hash of a word's bytes.
FACTOR = 0x9E3779B97F4A7C15
#: Powers of FACTOR and of its inverse are kept up to this exponent; longer texts are hashed in blocks of so many bytes.
BLOCK = 1 << 20


@cache
def powers(base: int) -> np.ndarray:
    """base to the powers 0 to BLOCK - 1, modulo 2 to the 64."""
    row = np.full(BLOCK, base, np.uint64)
    row[0] = 1
    return np.multiply.accumulate(row)


BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def hashed_words(texts: list[bytes | None], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after another, and how many each text has.

    Words are runs of bytes that are no ASCII blanks, once A-Z are lower-cased or bytes are replaced by a table. Nothing
    is done word by word: a hash is the scrambled difference of two prefix sums of the bytes times powers of FACTOR.
    The bytes are taken in blocks that end with a word, so what is held beside the texts and hashes does not grow with
    a text; only a word longer than a block is summed alone.
    """
    data = b"\n".join([t or b"" for t in texts]) + b"\n"
    data = np.frombuffer(data.translate(table) if table else data.lower(), np.uint8)
    hashes, begins, at = [], [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            blanks = np.flatnonzero(BLANK[data[at:end]])
            end = at + int(blanks[-1]) + 1 if len(blanks) else at + 1 + int(np.argmax(BLANK[data[at:]]))
        found, starts = _hashed_block(data[at:end])
        hashes.append(found)
        begins.append(starts + at)
        at = end
    bounds = np.cumsum([len(t or b"") + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(begins), bounds), prepend=0)


def _hashed_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of bytes of which the last one is blank."""
    blank = BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    n = len(data)
    if n > BLOCK:  # one word, then a blank
        total = 0
        for at in range(0, n - 1, BLOCK):
            part = data[at : min(at + BLOCK, n - 1)]
            total += int((part * powers(FACTOR)[: len(part)]).sum(dtype=np.uint64)) * pow(FACTOR, at, 1 << 64)
        return mix(np.array([total % (1 << 64)], np.uint64)), starts
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data * powers(FACTOR)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(pow(FACTOR, -1, 1 << 64))[starts]), starts


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width consecutive words."""
    n = max(len(hashes) - width + 1, 0)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + n]
    return mix(out)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes; a shorter text is one shingle, an empty one none."""
    every = windows(hashes, width)
    out, begin = [], 0
    for n in counts.tolist():
        own = every[begin : begin + n - width + 1] if n >= width else windows(hashes[begin : begin + n], n)[: min(n, 1)]
        begin += n
        own = np.sort(own)
        if len(own) > 1:
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            own = own[fresh]
        out.append(own)
    return out


#: Ids up to which a set of documents is sent to the scanning tasks; more are joined by a shuffle.
SENT_IDS = 1_000_000


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids, a stored table with distinct values in a column doc_id."""
    return docs.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "doc_id", "left_semi")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key brought together and next to each other, for ``groups``."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def groups(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The runs of rows that agree in keys, of rows that ``dealt`` has ordered."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        cuts = [*([0] if first != last and held else []), *np.flatnonzero(new).tolist()]
        begin = 0
        for cut in cuts:
            if cut > begin:
                held.append(batch.slice(begin, cut - begin))
            yield pa.Table.from_batches(held)
            held, begin = [], cut
        held.append(batch.slice(begin))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list array of numpy arrays."""
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))


def ranges(spark: SparkSession, n_bytes: int, each: int = 8 << 20) -> int:
    """Tasks for so many bytes: a few MB each, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of edges (a, b), label the smallest node that it is connected with.

    Alternating large-star and small-star rounds until only stars are left; each is a few joins and is written to the
    shared folder.
    """
    edges = store(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct(), "edges")

    def stars(e: DataFrame) -> bool:
        """Whether every node but the smallest of each component has one edge, to that one."""
        several = e.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi")
        return several.union(e.join(e.select(F.col("lo").alias("hi")), "hi", "left_semi").select("hi")).isEmpty()

    while not stars(edges):
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        last, edges = edges, store(small.where("hi != lo").distinct(), "edges")
        discard(last)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(edges.select("lo", "lo").distinct())
