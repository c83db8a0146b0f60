"""A stored inverted-file index with product-quantised residuals: built once, added to, and searched cell by cell."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from lattica.operators.graph import best
from lattica.operators.vectors import BLOCK, ROWS, _units, cosine, in_blocks

#: Rows that cells and codes are fitted on, and rows of these that probes and depth are measured with.
FITTED, MEASURED = 16_384, 256
#: Most cells, parts of a vector that are coded apart, and codes of a part (one byte).
CELLS, PARTS, CODES = 4096, 16, 256
#: Share of true neighbours, among the rows fitted on, that the cells probed and the candidates ranked again must hold.
CELL_SHARE, CODE_SHARE = 0.99, 0.99
#: Candidates ranked again, for each row asked for: twice what the fit needs, and at least so many.
DEPTH = 4.0
MODEL = "centroids binary, codebooks binary, cells int, dim int, parts int, codes int, probes int, depth_factor double, row_schema string"


@dataclass
class Model:
    """Unit centroids (cells, dim); codebooks (parts, codes, width) of residuals, the last parts filled with zeros."""

    centroids: np.ndarray
    codebooks: np.ndarray
    probes: int
    depth_factor: float

    @property
    def padded(self) -> int:
        return self.codebooks.shape[0] * self.codebooks.shape[2]

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Vectors as (rows, parts, width)."""
        full = np.zeros((len(x), self.padded), np.float32)
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), self.codebooks.shape[0], self.codebooks.shape[2])

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cell of unit vectors, and the codes of what is left beside its centroid."""
        cells = np.concatenate([np.argmax(x[i : i + 4096] @ self.centroids.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)
        rest = self.cut(x - self.centroids[cells])
        return cells, np.stack([_nearest(rest[:, p], book) for p, book in enumerate(self.codebooks)], axis=1).astype(np.uint8)

    def scores(self, queries: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Cosines of queries and rows as their cells and codes have them."""
        tables = np.einsum("qpw,pcw->qpc", self.cut(queries), self.codebooks)
        out = (queries @ self.centroids.T).astype(np.float32)[:, cells]
        for p in range(codes.shape[1]):
            out += tables[:, p][:, codes[:, p]]
        return out


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers * centers).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 4096] @ centers.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _means(x: np.ndarray, k: int, rounds: int, unit: bool = False) -> np.ndarray:
    """k-means from rows at even distances; a center without rows stays where it is."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centers)
        sums = np.zeros_like(centers, np.float64)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
        if unit:
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def fitted(x: np.ndarray, cells: int, k: int = 10) -> Model:
    """A model of unit vectors, with as many probes and candidates as their own neighbours need."""
    cells = max(1, min(cells, len(x)))
    centroids = _means(x, cells, 12, unit=True)
    width = -(-x.shape[1] // min(PARTS, x.shape[1]))
    parts = -(-x.shape[1] // width)
    model = Model(centroids, np.zeros((parts, 1, width), np.float32), 1, 1.0)
    rest = model.cut(x - centroids[_nearest(x, centroids)])
    model.codebooks = np.stack([_means(rest[:, p], min(CODES, len(x)), 8) for p in range(parts)]).astype(np.float32)
    own, codes = model.encoded(x)
    asked = np.linspace(0, len(x) - 1, min(MEASURED, len(x))).astype(int)
    exact = x[asked] @ x.T
    true = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    places = np.argsort(np.argsort(-(x[asked] @ centroids.T), axis=1, kind="stable"), axis=1)
    far = np.sort(np.take_along_axis(places, own[true], axis=1).ravel())
    model.probes = int(far[max(math.ceil(CELL_SHARE * len(far)) - 1, 0)]) + 1
    ranks = np.argsort(np.argsort(-model.scores(x[asked], own, codes), axis=1, kind="stable"), axis=1)
    deep = np.sort(np.take_along_axis(ranks, true, axis=1).ravel())
    model.depth_factor = max(DEPTH, 2 * (int(deep[max(math.ceil(CODE_SHARE * len(deep)) - 1, 0)]) + 1) / k)
    return model


class VectorIndex:
    """An index of rows (keys, embedding) in a folder: ``model``, and ``rows`` in a folder for each cell."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys
        m = spark.read.schema(MODEL).parquet(f"{path}/model").first()
        shape = lambda raw, *dims: np.frombuffer(raw, np.float32).reshape(dims)
        width = -(-m.dim // m.parts)
        self.schema = StructType.fromJson(json.loads(m.row_schema))
        self.model = Model(shape(m.centroids, m.cells, m.dim), shape(m.codebooks, m.parts, m.codes, width), m.probes, m.depth_factor)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def add(self, rows: DataFrame) -> VectorIndex:
        """Add rows: each is encoded by the stored model and appended to its cell."""
        model = self.spark.sparkContext.broadcast(self.model)
        held = rows.where("embedding IS NOT NULL").select(*self.keys, F.col("embedding").cast("array<double>").alias("embedding"))
        schema = StructType([*held.schema.fields, StructField("cell", IntegerType()), StructField("codes", BinaryType())])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            for batch in batches:
                for n, (at, x) in _units(batch.column("embedding")).items():
                    if n == m.centroids.shape[1] and len(at):
                        cells, codes = m.encoded(x.astype(np.float32))
                        part = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], schema=arrow)

        coded = held.mapInArrow(run, schema)
        # a task writes few cells, and a hot cell is spread over tasks
        coded.repartition("cell", F.pmod(F.xxhash64(*self.keys), F.lit(4))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
        return self

    def search(self, queries: DataFrame, k: int = 10, by: str | None = None, probes: int | None = None, depth: int | None = None) -> DataFrame:
        """The k nearest rows of each query (query_id, user_id, embedding) among those of the cells probed: query_id, asked_by, keys, score.

        Each query probes its nearest cells; only their folders are read, and of them only keys and codes. The best
        ``depth`` of a query by codes are ranked again by their own vectors, as ``nearest`` ranks. Probes and depth are,
        unless given, what the fit has found to be needed. With ``by``, a key that holds the tenant, only the query's
        tenant is searched. Null, zero and differently long vectors find nothing.
        """
        model = self.spark.sparkContext.broadcast(self.model)
        probes = min(probes or self.model.probes, len(self.model.centroids))
        depth = depth or math.ceil(k * self.model.depth_factor)
        asked = queries.where("embedding IS NOT NULL").select("query_id", F.col("user_id").alias("asked_by"), F.col("embedding").cast("array<double>").alias("embedding"))
        probed = StructType([*asked.schema.fields, StructField("cell", IntegerType())])
        to_cells = to_arrow_schema(probed)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            for batch in batches:
                for n, (at, x) in _units(batch.column("embedding")).items():
                    if n == m.centroids.shape[1] and len(at):
                        near = np.argsort(-(x.astype(np.float32) @ m.centroids.T), axis=1, kind="stable")[:, :probes]
                        part = batch.take(pa.array(np.repeat(at, probes)))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.ravel(), pa.int32())], schema=to_cells)

        asks = asked.mapInArrow(probe, probed)
        cells = [r.cell for r in asks.select("cell").distinct().collect()]  # at most CELLS numbers
        rows = self.rows.where(F.col("cell").isin(cells))
        held = rows.select("cell", *self.keys, "codes")
        schema = StructType([*asked.drop("embedding").schema.fields, *held.drop("codes").schema.fields, StructField("near", DoubleType())])
        arrow = to_arrow_schema(schema)
        keys, tenant = self.keys, by

        def top(some: pa.Table, batch: pa.RecordBatch, cell: int) -> Iterator[pa.RecordBatch]:
            """The best by codes, of the rows of one cell for the queries that probe it."""
            m = model.value
            q = np.stack(some.column("embedding").to_pylist()).astype(np.float32)
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            theirs = np.array(batch.column(tenant).to_pylist(), object) if tenant else None
            own = np.array(some.column("asked_by").to_pylist(), object)
            for i in range(0, len(q), 256):
                scores = m.scores(q[i : i + 256], np.full(len(codes), cell), codes)
                if tenant:
                    scores[(own[i : i + 256][:, None] != theirs[None]) | np.equal(theirs, None)[None]] = -np.inf
                bound = np.partition(scores, -depth, axis=1)[:, -depth] if scores.shape[1] > depth else np.full(len(scores), -np.inf)
                a, b = np.nonzero((scores >= bound[:, None]) & (scores > -np.inf))
                if len(a):
                    part, who = batch.take(pa.array(b)), some.take(pa.array(a + i))
                    columns = [who.column("query_id").combine_chunks(), who.column("asked_by").combine_chunks(), *(part.column(c) for c in ("cell", *keys)), pa.array(scores[a, b].astype(np.float64))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        if asks.limit(BLOCK + 1).count() <= BLOCK:
            shared = self.spark.sparkContext.broadcast(asks.toArrow())

            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                asks_of = {c: shared.value.filter(pa.compute.equal(shared.value.column("cell"), c)) for c in cells}
                for batch in batches:
                    own = batch.column("cell").to_numpy()
                    for c in np.unique(own).tolist():
                        yield from top(asks_of[c], batch.filter(pa.array(own == c)), c)

            found = held.mapInArrow(scan, schema)
        else:

            def run(some: pa.Table, block: pa.Table) -> pa.Table:
                out = []
                if some.num_rows and block.num_rows:
                    for batch in block.to_batches(max_chunksize=8192):
                        out += top(some, batch, int(batch.column("cell")[0].as_py()))
                return pa.Table.from_batches(out, arrow)

            found = in_blocks(asks, held, ["cell"], F.col("query_id"), [F.col(c) for c in keys], BLOCK, ROWS, run, schema)
        few = best(found, ["query_id"], [F.desc("near"), *[F.asc(c) for c in keys]], depth, "place").drop("place", "near")
        vectors = rows.select("cell", *keys, F.col("embedding").alias("_theirs"))
        near = few.join(vectors, ["cell", *keys]).join(asked.drop("asked_by"), "query_id")
        ranked = near.select("query_id", "asked_by", *keys, F.round(cosine(F.col("embedding"), F.col("_theirs")), 12).alias("score"))
        return best(ranked, ["query_id"], [F.desc("score"), *[F.asc(c) for c in keys]], k)


def build_index(rows: DataFrame, path: str, keys: list[str], cells: int | None = None, k: int = 10) -> VectorIndex:
    """An index under path of all rows (keys, which are together unique, and embedding) whose vectors have the most usual length.

    Cells, about the root of the number of rows and at most CELLS, and codes are fitted in one task on about FITTED
    rows picked by hash, a bounded sample; how many cells to probe, and how many candidates to rank again, is measured
    on these rows, so that they find CELL_SHARE and CODE_SHARE of their k nearest. Then every row is encoded where it
    lies and written to its cell. Null and zero vectors, and those of another length, are not in the index.
    """
    spark = rows.sparkSession
    good = rows.where("embedding IS NOT NULL AND exists(embedding, x -> x != 0)")
    size = good.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (size.dim, size.n) if size else (1, 0)
    sample = good.where(F.size("embedding") == dim)
    if n > FITTED:
        sample = sample.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int((1 << 30) * FITTED / n))
    model_schema = to_arrow_schema(StructType.fromDDL(MODEL))
    row_schema = StructType([*rows.select(*keys).schema.fields, StructField("embedding", ArrayType(DoubleType())), StructField("codes", BinaryType()), StructField("cell", IntegerType())]).json()
    wanted = cells or max(1, min(CELLS, math.isqrt(n)))

    def model(x: np.ndarray) -> dict:
        m = fitted(x, wanted, k)
        parts, codes, _ = m.codebooks.shape
        return {"centroids": m.centroids.astype(np.float32).tobytes(), "codebooks": m.codebooks.tobytes(), "cells": len(m.centroids), "dim": dim, "parts": parts, "codes": codes, "probes": m.probes, "depth_factor": m.depth_factor, "row_schema": row_schema}

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([v for batch in batches for _, v in _units(batch.column("embedding")).values()])
        yield pa.RecordBatch.from_pylist([model(x.astype(np.float32))], model_schema)

    if n:
        ordered = sample.select(F.col("embedding").cast("array<double>").alias("embedding"), F.xxhash64(*keys).alias("at")).repartition(1).sortWithinPartitions("at").select("embedding")
        found = ordered.mapInArrow(fit, MODEL)
    else:
        found = spark.createDataFrame([tuple(model(np.eye(1, dtype=np.float32)).values())], MODEL)
    found.write.mode("overwrite").parquet(f"{path}/model")
    return VectorIndex(spark, path, keys).add(rows)


def vector_topk_approx(queries: DataFrame, index: VectorIndex, k: int = 3) -> DataFrame:
    """``vector_topk`` by a stored index of entities (user_id, name): the k nearest of all tenants are found first, and the query's tenant is kept."""
    return index.search(queries, k).where("user_id = asked_by").drop("asked_by")
