import random

from lattica.operators import tables as tb
from lattica.operators.ranks import numbered, recent
from pyspark.sql import Window
from pyspark.sql import functions as F


def rows(spark, n=600):
    """A hot key with most rows, ties, null keys and null times."""
    r = random.Random(7)
    data = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, *range(300)]), i, f"x{i}") for i in range(n)]
    return spark.createDataFrame(data, "user_id string, at long, id long, rank string").repartition(5)


def test_numbered_is_row_number(spark):
    df = rows(spark)
    for order in ([F.asc("at"), F.asc("id")], [F.desc("at"), F.desc("id")], [F.asc_nulls_last("at"), F.desc("id")]):
        got = numbered(df, ["user_id"], order, "place")
        want = df.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert got.columns == [*df.columns, "place"]
    assert numbered(df.limit(0), ["user_id"], [F.asc("id")]).count() == 0


def test_a_hot_key_is_spread(spark):
    df = spark.range(40_000).select(F.lit("one").alias("user_id"), "id")
    got = numbered(df, ["user_id"], [F.desc("id")])
    assert got.where("rank != 40000 - id").count() == 0
    window = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line and "row_number" in line]
    assert window and all("_range" in line for line in window)


def test_recent_is_a_range_window(spark):
    df = rows(spark)
    for span in (1, 7, 50, 1000):
        window = Window.partitionBy("user_id").orderBy("at").rangeBetween(-span, 0)
        want = df.withColumn("n", F.count("*").over(window))
        got = recent(df, "user_id", F.col("at"), span, "n")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_quota(spark):
    df = rows(spark).withColumn("created_at", F.timestamp_seconds(F.coalesce("at", F.lit(5))))
    want = df.withColumn("over_quota", F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "id")) > 5)
    assert sorted(map(tuple, tb.document_quota(df).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
