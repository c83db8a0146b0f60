"""A permanent ledger of event ids: Bloom filters say which ids may have come before, and the ids themselves decide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.streaming.tiers import Tiered, drop_parts, folded

#: Bits for each id, and places of an id: about one id in 400 that has not come looks as if it had.
BITS, PLACES = 16, 4
#: Bits of one bitmap of the built-in bitmap functions.
BITMAP = 32_768


def _places(event_id: Column, bits: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(PLACES)), lambda j: F.pmod(F.xxhash64(event_id, j), bits) + 1)


class Ledger:
    """Ids of a folder, in parts with a Bloom filter each; a filter is rows of bitmaps, as long as its part needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ids = Tiered(spark, f"{path}/ids", "event_id string")

    def _filter(self, n: int) -> DataFrame:
        return self.spark.read.schema("bits long, bucket long, bitmap binary").parquet(f"{self.path}/filters/part={n}").withColumn("part", F.lit(n))

    def maybe(self, ids: DataFrame, number: int) -> DataFrame:
        """(event_id, part) of the ids that, by its filter, a part of the batches before one may hold."""
        held = self.ids.before(number)
        if not held:
            return ids.select("event_id", F.lit(0).alias("part")).where("false")
        filters = reduce(DataFrame.unionByName, [self._filter(n) for n in held])
        sizes = [(r.part, r.bits) for r in filters.select("part", "bits").distinct().collect()]  # a row for each part
        each = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(b).cast("long").alias("bits")) for p, b in sizes])).alias("p") if sizes else None
        if each is None:
            return ids.select("event_id", F.lit(0).alias("part")).where("false")
        asked = ids.select("event_id", each).select("event_id", "p.part", F.explode(_places(F.col("event_id"), F.col("p.bits"))).alias("x"))
        asked = asked.withColumns({"bucket": F.bitmap_bucket_number("x"), "at": F.bitmap_bit_position("x")})
        byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        seen = asked.join(filters, ["part", "bucket"]).where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1)
        return seen.groupBy("event_id", "part").agg(F.count("*").alias("n")).where(F.col("n") == PLACES).drop("n")

    def unseen(self, events: DataFrame, number: int) -> DataFrame:
        """The first event, by time, of each event_id that no batch before the number-th holds; events without an id are left out.

        Only the parts for which a filter answers are read, and only the ids for which one does are joined with them.
        """
        first = events.where("event_id IS NOT NULL").withColumn("event_id", F.col("event_id").cast("string"))
        rest = [c for c in first.columns if c != "event_id"]
        first = first.groupBy("event_id").agg(F.min(F.struct("ts", *[c for c in rest if c != "ts"])).alias("row")).select("event_id", "row.*").select(events.columns)
        hits = self.maybe(first.select("event_id"), number).persist()
        read = [r.part for r in hits.select("part").distinct().collect()]
        if read:
            known = reduce(DataFrame.unionByName, [self.ids.part(n) for n in sorted(read)])
            first = first.join(known.join(hits, "event_id", "left_semi"), "event_id", "left_anti")
        hits.unpersist()
        return first

    def record(self, events: DataFrame, number: int) -> None:
        """Add the ids of a batch, and the filter of the part that holds them."""
        ids = self.ids.write(events.select("event_id"), number)
        bits = max(BITMAP, 1 << (BITS * ids.count() - 1).bit_length())
        x = ids.select(F.explode(_places(F.col("event_id"), F.lit(bits))).alias("x"))
        maps = x.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bitmap"))
        maps.select(F.lit(bits).cast("long").alias("bits"), "bucket", "bitmap").write.mode("overwrite").parquet(f"{self.path}/filters/part={number + 1}")
        drop_parts(self.spark, f"{self.path}/filters", folded(number))
