"""Statistics of a graph kept up to date: each batch of triples changes counts by what is new in it, and reads no old triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.operators.graph import best
from lattica.operators.ranks import numbered

#: Buckets of names and relations, and batches after which changes are folded into one state.
BUCKETS, FOLDED = 16, 10
TOP_ENTITIES, TOP_TYPES = 8, 6
#: What is known after a batch: a row of a key with the highest version holds. Pairs are the files of a relation.
STATE = {
    "nodes": (("user_id", "name"), "user_id string, name string, type string, at struct<seq:bigint,side:int>, degree bigint, bucket int, version bigint"),
    "pairs": (("user_id", "source", "target", "type", "file"), "user_id string, source string, target string, type string, file string, bucket int, version bigint"),
    "counts": (("user_id", "metric", "key"), "user_id string, metric string, key string, n bigint, version bigint"),
    "tops": (("user_id", "name"), "user_id string, name string, degree bigint, version bigint"),
}


def _bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def _path(spark: SparkSession, name: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(name)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _state(spark: SparkSession, path: str, name: str, before: int, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a state table after the batches before a number: of each key the latest; of some buckets only, if asked for.

    Every FOLDED batches the whole state is written, so folders from the last such batch on are read.
    """
    keys, ddl = STATE[name]
    low = max(before - 1, 0) // FOLDED * FOLDED
    folders = [f"{path}/{name}/batch={n}" for n in range(low, before)]
    found = [f for f in folders if (p := _path(spark, f))[1].exists(p[0])]
    reader = spark.read.schema(ddl)
    # each folder is read by itself, as the folders in it name the buckets
    rows = reduce(DataFrame.unionByName, [reader.parquet(f) for f in found]) if found else spark.createDataFrame([], ddl)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    if name == "tops":  # a list that a batch writes replaces that of its tenant
        last = rows.groupBy("user_id").agg(F.max("version").alias("version"))
        return rows.join(last, ["user_id", "version"]).drop("version")
    if name == "pairs":
        return rows.drop("version")  # only ever added
    rest = [c for c in rows.columns if c not in (*keys, "version")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("row")).select(*keys, "row.*")


def _write(rows: DataFrame, path: str, name: str, number: int) -> None:
    columns = StructType.fromDDL(STATE[name][1]).fieldNames()
    writer = rows.withColumn("version", F.lit(number).cast("long")).select(columns)
    if "bucket" in columns:
        writer.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/batch={number}")
    else:
        writer.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")


def apply_batch(triples: DataFrame, path: str, number: int) -> None:
    """Change the state under path by a batch of triples (user_id, source, source_type, relation, target, target_type, source_file, seq), the number-th.

    Only names and relations of the batch are looked up, in the buckets that they lie in. New relations add to the degrees of both ends, a
    name's type changes when an earlier one that is not 'Entity' comes, and counts change by differences. As degrees
    only grow, the best entities are among the old best ones and those of the batch. A batch that
    runs again reads the state before it and replaces its own folders, so nothing counts twice.
    """
    spark = triples.sparkSession
    triples = triples.persist()
    held = []

    def kept(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    touched = lambda df: [r.bucket for r in df.select("bucket").distinct().collect()]  # noqa: E731  at most BUCKETS
    edge = ["user_id", "source", "target", "type"]
    pairs = kept(triples.select("user_id", "source", "target", F.col("relation").alias("type"), F.col("source_file").alias("file")).distinct().withColumn("bucket", _bucket(*edge)))
    old_pairs = kept(_state(spark, path, "pairs", number, touched(pairs)).join(pairs.select(*edge).distinct(), edge, "left_semi").select(*edge, "file"))
    same_file = [pairs[c].eqNullSafe(old_pairs[c]) for c in (*edge, "file")]
    new_pairs = kept(pairs.join(old_pairs, same_file, "left_anti"))
    new_edges = kept(pairs.select(*edge).distinct().join(old_pairs.select(*edge).distinct(), edge, "left_anti"))

    files = pairs.groupBy(*edge).agg(F.count("file").alias("named"))
    now = kept(files.join(old_pairs.groupBy(*edge).agg(F.count("file").alias("was")), edge, "left"))

    end = lambda c, side: F.struct(F.col(c).alias("name"), F.col(f"{c}_type").alias("type"), F.struct(F.col("seq").cast("long").alias("seq"), F.lit(side).alias("side")).alias("at"))
    ends = triples.select("user_id", F.explode(F.array(end("source", 0), end("target", 1))).alias("e")).select("user_id", "e.*")
    at = F.when(F.col("type") != "Entity", F.col("at"))
    told = ends.groupBy("user_id", "name").agg(F.min_by("type", at).alias("new_type"), F.min(at).alias("new_at"))
    gained = new_edges.select("user_id", F.explode(F.array("source", "target")).alias("name")).groupBy("user_id", "name").agg(F.count("*").alias("gained"))
    told = kept(told.join(gained, ["user_id", "name"], "left").withColumn("bucket", _bucket("user_id", "name")))
    old_nodes = _state(spark, path, "nodes", number, touched(told)).drop("bucket").withColumn("known", F.lit(True))
    both = told.join(old_nodes, ["user_id", "name"], "left")
    newer = F.col("new_at").isNotNull() & (F.col("at").isNull() | (F.col("new_at") < F.col("at")))
    nodes = kept(both.select("user_id", "name", "bucket", "known", F.col("type").alias("was"), F.when(newer, F.col("new_type")).otherwise(F.coalesce("type", F.lit("Entity"))).alias("type"), F.when(newer, F.col("new_at")).otherwise(F.col("at")).alias("at"), (F.coalesce("degree", F.lit(0)) + F.coalesce("gained", F.lit(0))).alias("degree")))

    delta = lambda df, metric, key, n=F.lit(1): df.select("user_id", F.lit(metric).alias("metric"), key.alias("key"), n.cast("long").alias("by"))
    none = F.lit("")
    changes = [
        delta(nodes.where("known IS NULL"), "node_count", none),
        delta(new_edges, "link_count", none),
        delta(nodes.where("known IS NULL OR was != type"), "type", F.col("type")),
        delta(nodes.where("known AND was != type"), "type", F.col("was"), F.lit(-1)),
        delta(new_edges, "relation_type", F.col("type")),
        delta(new_pairs.where("file IS NOT NULL"), "doc", F.col("file")),
        # a relation of no file counts as one of an unknown one, until it gets a file
        delta(now.where("was IS NULL AND named = 0"), "doc", F.lit("Unknown")),
        delta(now.where("was = 0 AND named > 0"), "doc", F.lit("Unknown"), F.lit(-1)),
    ]
    changed = reduce(DataFrame.unionByName, changes).groupBy("user_id", "metric", "key").agg(F.sum("by").alias("by"))
    counts = changed.join(_state(spark, path, "counts", number), ["user_id", "metric", "key"], "left").select("user_id", "metric", "key", (F.coalesce("n", F.lit(0)) + F.col("by")).alias("n"))
    rivals = _state(spark, path, "tops", number).join(nodes, ["user_id", "name"], "left_anti").join(nodes.select("user_id").distinct(), "user_id", "left_semi")
    tops = best(rivals.unionByName(nodes.select("user_id", "name", "degree")), ["user_id"], [F.desc("degree"), F.asc("name")], TOP_ENTITIES).drop("rank")

    written = {"nodes": nodes.select("user_id", "name", "type", "at", "degree", "bucket"), "pairs": new_pairs, "counts": counts, "tops": tops}
    for name, rows in written.items():
        if number and number % FOLDED == 0:
            rest = _state(spark, path, name, number)
            keys = ["user_id"] if name == "tops" else list(STATE[name][0])
            over = rows.select(*keys).distinct()
            rows = rows.unionByName(rest.join(over, [rest[c].eqNullSafe(over[c]) for c in keys], "left_anti"))
        _write(rows, path, name, number)
    if number and number % FOLDED == 0:
        for name in STATE:
            for n in range(max(number - 2 * FOLDED, 0), number - FOLDED):
                place, files = _path(spark, f"{path}/{name}/batch={n}")
                files.delete(place, True)
    _mark(spark, path, number)
    for df in [*held, triples]:
        df.unpersist()


def _mark(spark: SparkSession, path: str, number: int) -> None:
    """Say that a batch is whole: readers take those up to it."""
    place, files = _path(spark, f"{path}/done/{number}")
    files.mkdirs(place)


def _last(spark: SparkSession, path: str) -> int:
    place, files = _path(spark, f"{path}/done")
    return max((int(f.getPath().getName()) for f in files.listStatus(place)), default=-1) if files.exists(place) else -1


def live_statistics(triples: DataFrame, path: str, checkpoint: str):
    """A query that keeps the statistics of a stream of triples up to date under path; ``statistics`` reads them.

    Repeated triples change no count but are read like others; triples without a user, a name or a relation are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        whole = F.lit(True)
        for c in ("user_id", "source", "relation", "target"):
            whole &= F.col(c).isNotNull()
        apply_batch(batch.where(whole), path, number)

    return triples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, metric, key, value, rank) after the last batch, as ``graph_stats`` has them: counts, types, best entities, best relation types, documents."""
    number = _last(spark, path) + 1
    counts = _state(spark, path, "counts", number).where("n > 0")
    tops = _state(spark, path, "tops", number).select("user_id", F.lit("top_entity").alias("metric"), F.col("name").alias("key"), F.col("degree").alias("n"))
    ranked = numbered(counts.unionByName(tops), ["user_id", "metric"], [F.desc("n"), F.asc("key")])
    shown = ranked.where((F.col("metric") != "relation_type") | (F.col("rank") <= TOP_TYPES))
    return shown.select("user_id", "metric", F.when(~F.col("metric").isin("node_count", "link_count"), F.col("key")).alias("key"), F.col("n").alias("value"), F.col("rank").cast("long").alias("rank"))
