"""Line dedup (operator 10): DataFrame functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import store

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line with ASCII blanks stripped at both ends and A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines that at least min_docs documents share, except in the smallest id that holds them.

    Returns a struct column ``row`` (the input row), ``kept`` (the text left, lines joined by newlines), ``n_lines``
    and ``n_dropped``, one row for each input row. Lines are exploded to (id, position, 128-bit hash of the key);
    counts are combined before the shuffle, and only rows of shared keys are joined back, so a line that a third of
    all documents hold costs one small row for each of them. Two documents or more hold a key if its smallest and
    largest ids differ, so for min_docs of 2 these stand for the distinct count; else ids are counted.

    Null or empty text is one empty line. A row with a null id keeps all its lines and counts for no key. Rows that
    repeat an id count as one document; a line repeated within its first document stays there each time.
    """
    lines = lambda: F.split(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")), "\n", -1)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    base = base.withColumns({"id": F.col(f"row.`{id_col}`"), "copy": F.xxhash64(F.col(f"row.`{text_col}`"))})
    keyed = (
        base.where("id IS NOT NULL")
        .select("id", "copy", F.posexplode(F.transform(lines(), line_key)).alias("at", "key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "copy", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    if min_docs == 2:
        shared = keyed.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    else:
        shared = keyed.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs).drop("n")
    shared = store(shared, "shared-lines")  # a table of its own: a skewed side of the join can then be split
    dropped = keyed.join(shared, ["h1", "h2"]).where("id != first").groupBy("id", "copy").agg(F.collect_set("at").alias("gone"))
    n = F.size(lines())
    stay = F.array_except(F.sequence(F.lit(0), n - 1), "gone")
    # the one element of the outer array is the text's lines: split once, however many stay
    joined = F.transform(F.array(lines()), lambda own: F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n"))[0]
    left = F.when(F.col("gone").isNull(), F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))).otherwise(joined)
    return base.join(dropped, ["id", "copy"], "left").select("row", left.alias("kept"), n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """n_lines, n_dropped and the digest of the text left, for each document."""
    out = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (
  SELECT k.doc_id, k.ln, k.line, s.key IS NOT NULL AND k.doc_id <> s.first AS gone
  FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
