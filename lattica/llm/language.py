"""Language ID (operator 2): nearest of several TF-IDF n-gram centroids for each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_batches, remainder, tidy

#: Buckets of hashed letter trigrams.
DIMS = 8192
#: Rows of each language, about, that the centroids are fitted on; all training rows count for the document frequencies.
SAMPLE = 600
CENTROIDS = 4
#: Characters of a text whose trigrams are counted at once.
BLOCK = 1 << 18
UNKNOWN = "und"
#: A text is rejected if its cosine is below that of this share of the language's texts that are as long, by
#: the centroids of the other half of them; a length with fewer than ENOUGH texts takes the floor of a shorter one.
QUANTILE, ENOUGH = 0.005, 30
#: Lengths in characters, up to the next one, that have floors of their own.
LENGTHS = np.array([0, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096])


@cache
def _letters() -> np.ndarray:
    """For each code point below 65536: itself if a letter, else a blank."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(65536)], np.uint32)


def _letters_only(text: str) -> np.ndarray:
    """The code points of a text, blanks for all that are no letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _letters()[np.minimum(points, 65535)]
    far = np.flatnonzero(points > 65535)
    if len(far):
        known, place = np.unique(points[far], return_inverse=True)
        out[far] = np.array([p if chr(p).isalpha() else 32 for p in known.tolist()], np.uint32)[place]
    return out


def counts(texts: list[str | None]) -> np.ndarray:
    """A row for each text: how often each bucket's trigrams occur, over the whole text, which is taken in blocks."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        text = f"  {(text or '').lower()}  "
        for at in range(0, len(text) - 2, BLOCK):
            points = _letters_only(text[at : at + BLOCK + 2])
            a, b, c = points[:-2], points[1:-1], points[2:]
            code = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
            code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - DIMS.bit_length() + 1)
            row += np.bincount(code[b != 32], minlength=DIMS)
    return out


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; a zero row for a text without letters."""
    x = np.log1p(counts(texts)) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12, least: float = 0.04) -> np.ndarray:
    """Unit centroids of spherical k-means, begun from rows at even ranks of closeness to the mean.

    A cluster of less than this share of the rows is an odd text or two, and goes: its rows join the others.
    """
    centre = x.mean(axis=0)
    ranks = np.argsort(x @ centre, kind="stable")
    c = x[ranks[np.unique(((np.arange(k) + 0.5) / k * len(x)).astype(int))]]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sizes = np.bincount(own, minlength=len(c))
        kept = np.flatnonzero(sizes >= max(1, least * len(x)))
        c = np.stack([x[own == i].mean(axis=0) for i in kept])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def length_class(texts: list[str | None]) -> np.ndarray:
    """The number of each text's entry of LENGTHS."""
    return np.searchsorted(LENGTHS, [len(t or "") for t in texts], "right") - 1


def floors(texts: list[str], idf: np.ndarray, k: int) -> np.ndarray:
    """The floor of each length: longer texts are cut to the shortest of that length, so that all lengths are learned from all texts."""
    x = vectors(texts, idf)
    out = np.zeros(len(LENGTHS))
    if len(texts) < 2 * ENOUGH:
        return out
    halves = [cluster(x[i::2], k) for i in (0, 1)]
    for at, least in enumerate(LENGTHS.tolist()):
        near = []
        for i, c in enumerate(halves):
            own = [t[:least] for t in texts[1 - i :: 2] if least and len(t) >= least]
            if own:
                near.append((vectors(own, idf) @ c.T).max(axis=1))
        near = np.concatenate(near) if near else np.zeros(0)
        out[at] = np.quantile(near, QUANTILE) if len(near) >= ENOUGH else out[at - 1] if at else 0.0
    return np.maximum.accumulate(out)


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray  # the cosine below which a text is rejected, of each centroid and length

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the text is rejected."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        near = vectors(texts, self.idf) @ self.centroids.T
        best = np.argmax(near, axis=1)
        score = np.clip(near[np.arange(len(texts)), best], 0, 1).astype(float)
        known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)  # as ``_letters`` has it: no digits, fractions or Roman numerals
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), ~known | (score < self.floors[best, length_class(texts)])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Learn centroids from labelled rows.

    Document frequencies come from all rows. Centroids come from a sample of about ``sample`` rows of each language,
    drawn by the hash of the key, so that a language's rows, however many, fit into one group. Rows with a null
    text, language or key, or no letters, teach nothing; without any row left, everything is rejected.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(key_col).alias("draw"), F.col(key_col).isNotNull().alias("keyed")).where("text IS NOT NULL AND lang IS NOT NULL AND keyed")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                x = counts(batch.column("text").slice(i, 256).to_pylist())
                total += (x > 0).sum(axis=0)
                n += len(x)
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(-1, DIMS, dtype=np.int32), "n": np.concatenate([[n], total])})

    df = {r.bucket: r.n for r in rows.select("text").mapInArrow(tidy(frequencies), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    n = df.get(-1, 0)
    idf = np.array([np.log((1 + n) / (1 + df.get(i, 0))) + 1 for i in range(DIMS)], np.float32)
    shares = {r.lang: min(1.0, sample / r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Model(idf, [], np.zeros((0, DIMS), np.float32), np.zeros((0, len(LENGTHS))))
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]

    def centroids(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("text", "ascending")])
        texts = table.column("text").to_pylist()
        x = vectors(texts, idf)
        some = x.any(axis=1)
        x, texts = x[some], [t for t, s in zip(texts, some, strict=True) if s]
        c = cluster(x, k) if len(x) else np.zeros((0, DIMS), np.float32)
        floor = [floors(texts, idf, k).tolist()] * len(c)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(c), pa.string()), "centroid": pa.array(list(c), pa.list_(pa.float32())), "floor": pa.array(floor, pa.list_(pa.float64()))})

    drawn = rows.where(F.pmod("draw", F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang", "draw")
    got = sorted(drawn.groupBy("lang").applyInArrow(centroids, "lang string, centroid array<float>, floor array<double>").collect(), key=lambda r: (r.lang, r.centroid))
    return Model(idf, [r.lang for r in got], np.array([r.centroid for r in got], np.float32).reshape(-1, DIMS), np.array([r.floor for r in got]).reshape(-1, len(LENGTHS)))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """One row for each row of docs: a struct column ``row`` (the input row), lang_pred, score (cosine) and rejected.

    A null text or one without a letter is ``und``, score 0, rejected. Only the text is read for the prediction.
    """
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts):
        import pandas as pd

        langs, scores, rejected = [], [], []
        for i in range(0, len(texts), 256):
            a, b, c = shared.value.predict(texts.iloc[i : i + 256].where(texts.iloc[i : i + 256].notna(), None).tolist())
            langs += a
            scores += b.tolist()
            rejected += c.tolist()
        return pd.DataFrame({"lang_pred": langs, "score": scores, "rejected": rejected})

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, predict(F.col(text_col).cast("string")).alias("p")).select("row", "p.lang_pred", "p.score", "p.rejected")


def trained(docs: DataFrame) -> Model:
    """The model of the query and the pipeline: rows whose crc32(doc_id) mod 4 is 2 are held out."""
    return fit(docs.where(remainder(F.col("doc_id"), 4) != 2))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), trained(docs))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.coalesce(remainder(F.col("row.doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
