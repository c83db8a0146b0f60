"""Cosine search over embedding tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from lattica.functions.text import clean_answer
from lattica.operators.graph import best
from lattica.sources.shared import stored

#: Queries sent to the tasks that scan the rows, or of one block of a larger stated set, and rows that meet such a block in a task.
BLOCK, ROWS = 4096, 1 << 16


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector, and for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def unit(v: Column) -> Column:
    """The vector over its length, so that a cosine is a dot product."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def _units(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, which rows have it and their unit vectors; null and zero ones are left out."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    out = {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        norm = np.sqrt((x * x).sum(axis=1))
        good = norm > 0
        out[n] = (at[good], x[good] / norm[good, None])
    return out


def matches(asked: tuple, batch: pa.RecordBatch, k: int, keys: list[str], by: str | None, least: float, descending: tuple[str, ...], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The k rows of a batch of highest cosine for each of the queries (ids, tenants, unit vectors by length), multiplied as matrices."""
    ids, tenants, own = asked
    order = pa.table({c: batch.column(c) for c in keys}).append_column("at", pa.array(np.arange(batch.num_rows))).sort_by([(c, "descending" if c in descending else "ascending") for c in keys]).column("at").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    theirs = np.array(batch.column(by).to_pylist(), object) if by else None
    picked: list[list[np.ndarray]] = [[], [], []]
    for n, (at, x) in _units(batch.column("embedding")).items():
        if n not in own:
            continue
        q_at, q = own[n]
        for i in range(0, len(q_at), 256):
            scores = np.round(q[i : i + 256] @ x.T, 12)
            if by:
                scores[tenants[q_at[i : i + 256]][:, None] != theirs[at][None]] = -np.inf
                scores[:, np.equal(theirs[at], None)] = -np.inf
            bound = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
            a, b = np.nonzero((scores >= np.maximum(bound, least)[:, None]) & (scores > -np.inf))
            s = scores[a, b]
            best_first = np.lexsort((rank[at[b]], -s, a))
            a, b, s = a[best_first], b[best_first], s[best_first]
            nth = np.arange(len(a)) - np.searchsorted(a, a)
            for o, v in zip(picked, (q_at[i : i + 256][a], at[b], s), strict=True):
                o.append(v[nth < k])
    if picked[0]:
        q_rows, r_rows, s = (np.concatenate(p) for p in picked)
        part = batch.take(pa.array(r_rows))
        columns = [ids.take(pa.array(q_rows)), pa.array(tenants[q_rows].tolist(), arrow.field("asked_by").type), *(part.column(c) for c in keys), pa.array(s)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _flat(table: pa.Table) -> tuple:
    """Queries as ``matches`` takes them."""
    table = table.combine_chunks()
    ids, tenants, vectors = (table.column(c).combine_chunks() if table.num_rows else pa.array([], table.schema.field(c).type) for c in ("query_id", "asked_by", "embedding"))
    return ids, np.array(tenants.to_pylist(), object), _units(vectors)


def in_blocks(asked: DataFrame, held: DataFrame, on: list[str], ids: Column, keys: list[Column], per_asked: int, per_held: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """``run`` on every block of queries with every block of rows that agree in ``on``, on the executors.

    Blocks are dealt by hash, as many for each value of ``on`` as its rows and queries need, so a hot value is spread
    over tasks; a row is sent once for each block of queries. Values without queries or without rows send nothing.
    """
    if not on:
        asked, held, on = asked.withColumn("_all", F.lit(0)), held.withColumn("_all", F.lit(0)), ["_all"]
    count = lambda df, each, name: df.groupBy(*on).agg(F.ceil(F.count("*") / each).cast("int").alias(name))
    sizes = stored(count(asked, per_asked, "_qs").join(count(held, per_held, "_rs"), on), "sizes")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(sizes, on).withColumns({"_q": F.pmod(F.xxhash64(ids), F.col("_qs")).cast("int"), "_r": every("_rs")}).drop("_qs", "_rs")
    right = held.join(sizes, on).withColumn("_r", F.pmod(F.xxhash64(*keys), F.col("_rs")).cast("int")).withColumn("_q", every("_qs")).drop("_qs", "_rs")
    block = [*on, "_q", "_r"]
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(run, schema)


def nearest(queries: DataFrame, rows: DataFrame, k: int, keys: list[str], by: str | None = None, least: float = -2.0, descending: tuple[str, ...] = ()) -> DataFrame:
    """The k rows of highest cosine of each query (query_id, user_id, embedding): query_id, asked_by, the keys of rows, score.

    Up to BLOCK queries are sent to the tasks that scan the rows in Arrow batches; more are dealt into blocks that meet
    blocks of rows on the executors. Either way a batch is multiplied as a matrix, and only its best k for each
    query go on to the shuffle. With ``by``, a key that holds the tenant, a query sees its own tenant's rows only.
    Scores are rounded to 12 digits, so that equal vectors tie wherever they stand; ties go to the smaller keys, in
    their order, or the larger of those named descending. Null, zero and differently long vectors are not compared; scores below least are left out.
    """
    spark = rows.sparkSession
    asked = queries.where("embedding IS NOT NULL").select("query_id", F.col("user_id").alias("asked_by"), F.col("embedding").cast("array<double>").alias("embedding"))
    held = rows.where("embedding IS NOT NULL").select(*keys, F.col("embedding").cast("array<double>").alias("embedding"))
    schema = StructType([*asked.drop("embedding").schema.fields, *held.drop("embedding").schema.fields, StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)
    most = BLOCK
    if asked.limit(most + 1).count() <= most:
        shared = spark.sparkContext.broadcast(asked.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _flat(shared.value)
            for batch in batches:
                yield from matches(own, batch, k, keys, by, least, descending, arrow)

        found = held.mapInArrow(scan, schema)
    else:

        def run(some: pa.Table, block: pa.Table) -> pa.Table:
            own = _flat(some)
            out = [m for batch in block.to_batches(max_chunksize=8192) for m in matches(own, batch, k, keys, by, least, descending, arrow)]
            return pa.Table.from_batches(out, arrow)

        if by:  # one name for the tenant on both sides
            asked, held = asked.withColumn("_by", F.col("asked_by")), held.withColumn("_by", F.col(by))
        found = in_blocks(asked, held, ["_by"] if by else [], F.col("query_id"), [F.col(c) for c in keys], most, ROWS, run, schema)
    return best(found, ["query_id"], [F.desc("score"), *[F.desc(c) if c in descending else F.asc(c) for c in keys]], k)


def vector_topk(queries: DataFrame, entities: DataFrame, k: int = 3, prefilter: bool = False) -> DataFrame:
    """The k nearest entities (user_id, name, embedding) of each query (query_id, user_id, embedding).

    As the index does it, the k nearest of all tenants are found first and the query's tenant is kept; prefilter looks
    at the tenant's entities only. Ties go to the smaller tenant and name.
    """
    found = nearest(queries, entities, k, ["user_id", "name"], by="user_id" if prefilter else None)
    return found.where("user_id = asked_by").drop("asked_by")


def chunk_topk(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest chunks (user_id, doc_id, chunk_idx, embedding) of the query's tenant."""
    return nearest(queries, chunks, k, ["user_id", "doc_id", "chunk_idx"], by="user_id").drop("asked_by")


def cache_lookup_semantic(questions: DataFrame, cache: DataFrame, least: float = 0.95) -> DataFrame:
    """The nearest cached answer of the same user, of at least this cosine; only for questions without history. Of equals the latest, then the largest answer."""
    asked = questions.where("NOT has_history").select(F.col("question_id").alias("query_id"), "user_id", "embedding")
    found = nearest(asked, cache, 1, ["user_id", "created_at", "answer"], by="user_id", least=least, descending=("created_at", "answer"))
    return found.select(F.col("query_id").alias("question_id"), "answer", "score")


def cache_lookup_exact(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """The latest answer of the same user to the same question, in any case."""
    asked = questions.select("question_id", "user_id", F.lower("question").alias("low"))
    held = cache.select("user_id", F.lower("question").alias("low"), "answer", "created_at")
    return asked.join(held, ["user_id", "low"]).groupBy("question_id").agg(F.max_by("answer", F.struct("created_at", "answer")).alias("answer"))


def cache_append(cache: DataFrame, answered: DataFrame) -> DataFrame:
    """The cache with clean answers of questions that have an embedding and no history."""
    new = answered.where("embedding IS NOT NULL AND NOT has_history").withColumn("answer", clean_answer(F.col("answer")))
    return cache.unionByName(new.select(cache.columns))
