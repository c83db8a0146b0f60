"""Token ids packed into rows of a fixed length (operator 6)."""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.common import arrow_schema, rows_of, slices, tidy

CAPACITY = 2048
#: Text whose documents are packed together, in one task.
PACK_BYTES = 16 << 20

SCHEMA = "doc_ids array<bigint>, piece_starts array<int>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, ids binary"


class Free:
    """A segment tree over the free capacities 0..most: which smallest one, at least as large as asked, some bin has."""

    def __init__(self, most: int):
        self.size = 1 << (most + 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = defaultdict(list)

    def _add(self, free: int, by: int) -> None:
        i = free + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least free capacity of need or more, and that capacity."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        free = i - self.size
        self._add(free, -1)
        return self.bins[free].pop(), free


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (document, start, length): longer documents are cut into whole bins and a rest, so that nothing is lost."""
    pieces = []
    bins: list[list[tuple[int, int, int]]] = []
    for d, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            bins.append([(d, start, capacity)])
        if n % capacity:
            pieces.append((n % capacity, d, n - n % capacity))
    free = Free(capacity)
    for n, d, start in sorted(pieces, key=lambda p: (-p[0], p[1])):
        b, room = free.take(n) or (len(bins), capacity)
        if b == len(bins):
            bins.append([])
        bins[b].append((d, start, n))
        if room > n:
            free.put(room - n, b)
    return bins


def byte_bpe(path: str | None = None):
    """The byte-level BPE of the public 50k vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 50256, pad_id: int = 50256, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, end it with end_id, and pack the documents into rows of capacity ids.

    Each task packs the documents of about PACK_BYTES of its text by best fit, longest first; nothing is shuffled. A
    longer document fills whole rows and its rest is packed as a document of its own. A row holds ``ids`` (capacity
    little-endian 16-bit ids, padded), ``n_tokens`` without padding, and for each segment the document
    (``doc_ids``), where it starts in that document (``piece_starts``), ``cu_seqlens`` (0, then the end of each
    segment) and ``position_resets`` (offsets at which positions start again from 0: of each segment, and of the
    padding). Null and empty texts are the end id alone; a null id stays null; repeated rows are packed each time.
    """
    if not 0 < max(end_id, pad_id) < 65536:
        raise ValueError("ids have to fit into 16 bits")

    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(vocabulary)
        for part in slices(batches, most=PACK_BYTES):
            owners = part.column("doc_id").to_pylist()
            ids = [np.array([*coder.encode_ordinary((t or b"").decode()), end_id], "<u2") for t in part.column("text").to_pylist()]
            rows = best_fit_decreasing([len(x) for x in ids], capacity)
            for at in range(0, len(rows), 1000):
                out: list[list] = [[] for _ in schema]
                for row in rows[at : at + 1000]:
                    ends = np.cumsum([n for _, _, n in row]).tolist()
                    matrix = np.full(capacity, pad_id, "<u2")
                    matrix[: ends[-1]] = np.concatenate([ids[d][s : s + n] for d, s, n in row])
                    for column, value in zip(out, ([owners[d] for d, _, _ in row], [s for _, s, _ in row], [0, *ends], [0, *(ends[:-1] if ends[-1] == capacity else ends)], ends[-1], matrix.tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return rows_of(docs, id_col, text_col).mapInArrow(tidy(run), SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the rows as parquet; ``matrix`` reads the ids of some of them."""
    packed.write.parquet(path)


def matrix(rows: list[bytes]) -> np.ndarray:
    """The id matrix of some rows' ids."""
    return np.stack([np.frombuffer(r, "<u2") for r in rows])


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Every document packed into rows of 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
