"""Tables that grow by a part with each batch, folded in tiers: a reader meets a few parts, and a row is rewritten a few times."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Parts that are folded into one of the next tier.
FAN = 8


def cover(n: int) -> int:
    """How many batches the n-th part (from 1) holds: the largest power of FAN that divides n."""
    size = 1
    while n % (size * FAN) == 0:
        size *= FAN
    return size


def parts(n: int) -> list[int]:
    """The parts that hold the first n batches, the last first."""
    out = []
    while n > 0:
        out.append(n)
        n -= cover(n)
    return out


def folded(number: int) -> range:
    """The parts that the last batch before one has folded: they can go, as it is committed."""
    return range(number - cover(number) + 1, number) if number else range(0)


def _folder(spark: SparkSession, name: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(name)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_parts(spark: SparkSession, path: str, numbers: Iterable[int]) -> None:
    for p in numbers:
        place, files = _folder(spark, f"{path}/part={p}")
        files.delete(place, True)


class Tiered:
    """A table under path; the batch numbered k (from 0) writes the part k + 1."""

    def __init__(self, spark: SparkSession, path: str, ddl: str | StructType, merge: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.spark, self.path, self.merge = spark, path, merge
        self.schema = StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl

    def part(self, n: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/part={n}")

    def before(self, number: int) -> list[int]:
        """The parts that hold the batches before one."""
        return parts(number)

    def rows(self, number: int) -> DataFrame:
        """The rows of the batches before one, as the parts hold them."""
        found = [f"{self.path}/part={n}" for n in self.before(number)]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def read(self, number: int) -> DataFrame:
        """The rows of the batches before one, merged."""
        return self.merge(self.rows(number)) if parts(number) else self.rows(number)

    def write(self, rows: DataFrame, number: int) -> DataFrame:
        """Write the part of a batch, folded with those that it covers, and return it as read again.

        A batch that runs again replaces its part. Parts that the last batch has folded go.
        """
        n = number + 1
        covered = [p for p in parts(number) if p > n - cover(n)]
        rows = reduce(DataFrame.unionByName, [self.part(p) for p in covered], rows.select(self.schema.fieldNames()))
        (self.merge(rows) if covered else rows).select(self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/part={n}")
        drop_parts(self.spark, self.path, folded(number))
        return self.part(n)

    def size(self) -> int:
        """Batches written so far."""
        place, files = _folder(self.spark, self.path)
        found = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
        return max((int(f.split("=")[1]) for f in found if f.startswith("part=")), default=0)
