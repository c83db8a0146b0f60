"""Substring search without comparing every name of a tenant: an inverted index of letter triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def grams(text: Column, width: int = WIDTH) -> Column:
    """The distinct runs of width characters of a text; a shorter text is its own and only one, an empty one has none."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - width + 1, F.lit(1)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(width)))))


def containing(needles: DataFrame, texts: DataFrame, needle: str, text: str, on: str = "user_id") -> DataFrame:
    """The rows of needles joined with those of texts of the same ``on`` whose text contains the needle.

    A needle meets the texts that hold its rarest triple (of those texts), and only these are tested, so a tenant's rows
    are spread over its triples and a needle that hardly any text holds meets hardly any. Needles under three
    characters are looked up among the runs of their own length. Null or empty needles, and null texts, match nothing;
    repeated rows give repeated rows. Columns other than ``on`` have to differ between the two.
    """
    asked = needles.where(F.col(needle) != "")
    wanted = asked.select(on, needle).distinct().select(on, needle, F.explode(grams(F.col(needle))).alias("_gram"))
    held = texts.where(F.col(text).isNotNull())
    # runs of one and two characters are only looked up by needles as short
    every = F.array_distinct(F.flatten(F.array(*[grams(F.col("_text"), w) for w in range(1, WIDTH + 1)])))
    posted = held.select(on, F.col(text).alias("_text")).distinct().select(on, "_text", F.explode(every).alias("_gram"))
    posted = posted.join(wanted.select(on, "_gram").distinct(), [on, "_gram"], "left_semi")
    often = posted.groupBy(on, "_gram").agg(F.count("*").alias("_n"))
    rarest = wanted.join(often, [on, "_gram"], "left").groupBy(on, needle).agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_gram"), F.min(F.coalesce("_n", F.lit(0))).alias("_least")).where("_least > 0").drop("_least")
    pairs = rarest.join(posted, [on, "_gram"]).where(F.col("_text").contains(F.col(needle))).select(on, needle, "_text")
    return asked.join(pairs, [on, needle]).join(held.withColumn("_text", F.col(text)), [on, "_text"]).drop("_text")
