"""A stored index for substring search: posting lists of letter runs, built once, added to, and read only where needles look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.operators.search import WIDTH, grams

#: Folders of postings and of texts; and lists of a needle that are intersected, the rarest ones.
BUCKETS, LISTS = 64, 3
#: Runs that needles look up to which the scan is told of each, so that blocks of the files can be skipped.
TOLD = 512


class TextIndex:
    """Texts (user_id, text) under path: ``texts`` by the hash of each, and ``postings`` (user_id, gram, id) by the hash of a run.

    Files of postings are sorted by run, so the smallest and largest run that parquet keeps of each of their blocks say
    which ones to skip. Ids are hashes of user and text; texts are tested themselves, so equal hashes do no harm.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def _bucket(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")

    def _read(self, name: str, ddl: str) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)
        schema = StructType.fromDDL(f"{ddl}, bucket int")
        return self.spark.read.schema(schema).parquet(place.toString()) if there else self.spark.createDataFrame([], schema)

    @property
    def texts(self) -> DataFrame:
        return self._read("texts", "user_id string, text string, id bigint")

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", "user_id string, gram string, id bigint")

    def add(self, texts: DataFrame) -> TextIndex:
        """Add texts (user_id, text) that the index does not hold; nulls are left out.

        Texts are written after their postings: what an add that has failed leaves behind finds no text, and is found once the
        texts are added again, since repeated postings count once.
        """
        new = texts.where("user_id IS NOT NULL AND text IS NOT NULL").select("user_id", "text").distinct().withColumn("id", F.xxhash64("user_id", "text")).withColumn("bucket", self._bucket("id"))
        new = new.join(self.texts.select("user_id", "text", "bucket"), ["user_id", "text", "bucket"], "left_anti").select("user_id", "text", "id", "bucket").persist()
        # runs of one and two characters are only looked up by needles as short
        every = F.array_distinct(F.flatten(F.array(*[grams(F.col("text"), w) for w in range(1, WIDTH + 1)])))
        posted = new.select("user_id", F.explode(every).alias("gram"), "id").withColumn("bucket", self._bucket("gram"))
        posted.repartition("bucket", F.pmod(F.col("id"), F.lit(4))).sortWithinPartitions("bucket", "gram", "user_id").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/texts")
        new.unpersist()
        return self

    def search(self, needles: DataFrame) -> DataFrame:
        """(user_id, needle, text) for each distinct needle (user_id, needle) and each text of its user that contains it.

        Only the folders, and blocks, of the needles' runs are read. The lengths of their lists are counted, and a needle's
        LISTS rarest lists are intersected: a needle of common runs meets only the texts that hold all of these. What is left
        is tested on the texts themselves, read from the folders of their ids. Null and empty needles find nothing.
        """
        asked = needles.where("user_id IS NOT NULL AND needle != ''").select("user_id", "needle").distinct()
        wanted = asked.select("user_id", "needle", F.explode(grams(F.col("needle"))).alias("gram")).withColumn("bucket", self._bucket("gram"))
        looked = wanted.select("gram", "bucket").distinct().limit(TOLD + 1).collect()
        if len(looked) <= TOLD:
            postings = self.postings.where(F.col("bucket").isin([r.bucket for r in looked]) & F.col("gram").isin([r.gram for r in looked]))
        else:
            postings = self.postings.where(F.col("bucket").isin([r.bucket for r in wanted.select("bucket").distinct().collect()]))
        lists = postings.join(wanted.select("user_id", "gram").distinct(), ["user_id", "gram"], "left_semi").select("user_id", "gram", "id").distinct()
        often = lists.groupBy("user_id", "gram").agg(F.count("*").alias("n"))
        ranked = wanted.drop("bucket").join(often, ["user_id", "gram"], "left").groupBy("user_id", "needle").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("lists"))
        few = ranked.where(F.col("lists")[0]["n"] > 0).select("user_id", "needle", F.slice("lists", 1, LISTS).alias("lists"))
        few = few.select("user_id", "needle", F.size("lists").alias("all"), F.explode("lists.gram").alias("gram"))
        met = few.join(lists, ["user_id", "gram"]).groupBy("user_id", "needle", "all", "id").agg(F.count("*").alias("n")).where(F.col("n") == F.col("all"))
        met = met.select("user_id", "needle", "id").withColumn("bucket", self._bucket("id"))
        return met.join(self.texts, ["user_id", "id", "bucket"]).where(F.col("text").contains(F.col("needle"))).select("user_id", "needle", "text")
