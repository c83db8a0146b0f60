"""Numbering and sliding counts that spread a hot key over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.shared import stored


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The rows of df with their place, from 1, within their key in a total order, as ``row_number`` has it.

    Rows are dealt by ranges of key and order, so that a key with many rows lies in several ranges, and stored. Each range numbers
    its rows of a key alone; the counts of a key's earlier ranges, one small row for each range and key, are added. Where a
    window over a key would sort all its rows in one task, none holds more than a range here. Null keys are a key.
    """
    ranged = df.repartitionByRange(*[F.asc(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "ranges")  # the ranges are sampled: they are fixed once they are written
    counts = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    joined = ranged.withColumn("_own", own)
    same = [joined["_range"] == starts["_range"], *[joined[k].eqNullSafe(starts[f"_k{i}"]) for i, k in enumerate(keys)]]
    return joined.join(starts, same).select(*[joined[c] for c in df.columns], (F.col("_own") + F.col("_start")).alias(name))


def recent(df: DataFrame, key: str, micros: Column, span: int, name: str) -> DataFrame:
    """The rows of df with how many rows of their key lie in the span of microseconds up to them, themselves and equal times included.

    Time is cut in slices as long as the span; a row also goes to the next slice, as what a row there may look back on.
    So a key's rows are counted slice by slice, each in a window of its own. Rows without a time are counted with the others
    of their key without one.
    """
    slice_ = F.coalesce(F.floor(F.col("_at") / span), F.lit(-(1 << 62)))
    both = F.explode(F.when(F.col("_at").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("_later")
    rows = df.withColumn("_at", micros).select("*", both).withColumn("_slice", slice_ + F.col("_later"))
    window = Window.partitionBy(key, "_slice").orderBy("_at").rangeBetween(-span, 0)
    return rows.withColumn(name, F.count("*").over(window)).where("_later = 0").drop("_at", "_later", "_slice")
