"""Where models plug in: user-supplied Python functions, called on Arrow batches. Nothing here reaches a network."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from lattica.functions.text import validate_class


def classify(df: DataFrame, classifier: Callable[[str], str], text_col: str = "text", out: str = "doc_class") -> DataFrame:
    """The validated class of the first 500 characters; 'general' where the classifier fails."""

    @F.pandas_udf("string")
    def label(samples: pd.Series) -> pd.Series:
        def one(s):
            try:
                return classifier(s)
            except Exception:
                return None

        return samples.map(one)

    return df.withColumn(out, validate_class(label(F.substring(text_col, 1, 500))))


def extract(chunks: DataFrame, extractor: Callable[[str], str]) -> DataFrame:
    """Adds ``raw``, the extractor's answer to ``content``; null where it fails, so that only this chunk is skipped."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return extractor(t)
            except Exception:
                return None

        return texts.map(one)

    return chunks.withColumn("raw", run("content"))


def _entities(raw: str | None) -> list[dict]:
    """Names, of two characters or more and not all digits, and types of the entities of an answer; none if it cannot be read."""
    try:
        found = json.loads(re.search(r"(?s)\{.*\}", re.sub(r"(?i)```(?:json)?", "", raw))[0])["entities"]
        named = [{"name": " ".join(e["name"].split()), "type": (e.get("type") or "").strip() or "Entity"} for e in found]
    except (AttributeError, KeyError, TypeError, ValueError):
        return []
    return [e for e in named if len(e["name"]) > 1 and not e["name"].isdecimal()]


def extract_in_order(chunks: DataFrame, extractor: Callable[[str, dict, list[dict]], str], template: list[str], most: int = 200) -> DataFrame:
    """Adds ``raw``, the extractor's answer to ``content``, the template columns of the row, and the entities that earlier chunks of its document have brought.

    Of these, the last ``most`` in order of first appearance, each name once in any case, are given. Documents are dealt to
    tasks, which go through their chunks in order; null where the extractor fails, so that only this chunk is skipped.
    """
    schema = StructType([*chunks.schema.fields, StructField("raw", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, seen, known = None, set(), deque(maxlen=most)
        for batch in batches:
            answers: list[str | None] = []
            for row in batch.select(["doc_id", "content", *template]).to_pylist():
                if row["doc_id"] != doc:
                    doc, seen, known = row["doc_id"], set(), deque(maxlen=most)
                try:
                    raw = extractor(row["content"], {t: row[t] for t in template}, list(known))
                except Exception:
                    raw = None
                for e in _entities(raw):
                    if e["name"].lower() not in seen:
                        seen.add(e["name"].lower())
                        known.append(e)
                answers.append(raw)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], schema.fieldNames())

    return chunks.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_idx").mapInArrow(run, schema)


def embed_in_batches(df: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None, text_col: str = "name", size: int = 100, out: str = "embedding") -> DataFrame:
    """Adds the vectors that embed returns for lists of at most size texts, in their order; null for a list that fails, and everywhere without embed."""
    if embed is None:
        return df.withColumn(out, F.lit(None).cast("array<float>"))
    schema = StructType([*df.drop(out).schema.fields, StructField(out, ArrayType(FloatType()))])
    columns = df.drop(out).columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            texts = frame[text_col].tolist()
            for i in range(0, len(texts), size):
                part = texts[i : i + size]
                try:
                    got = [None if v is None else [float(x) for x in v] for v in embed(part)]
                    vectors += got if len(got) == len(part) else [None] * len(part)
                except Exception:
                    vectors += [None] * len(part)
            yield frame[columns].assign(**{out: vectors})

    return df.drop(out).mapInPandas(run, schema)


def propose_types(names: DataFrame, classifier: Callable[[list[str]], dict[str, str]], size: int = 100) -> DataFrame:
    """Adds ``proposed``, the type that the classifier gives a name of a batch; null for names it leaves out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            proposed: list = []
            for i in range(0, len(frame), size):
                part = frame["name"].iloc[i : i + size].tolist()
                try:
                    got = classifier(part)
                except Exception:
                    got = {}
                proposed += [got.get(n) for n in part]
            yield frame.assign(proposed=proposed)

    return names.mapInPandas(run, StructType([*names.schema.fields, StructField("proposed", StringType())]))
