"""Global positions of sorted rows without one task for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BITS = 33


class Ranked:
    """Rows in a total order, written once.  They are dealt by range of the keys and
    sorted in their part; a row keeps its part and its place there, and the driver holds
    one number a part."""

    def __init__(self, spark: SparkSession, path: str, sizes: dict[int, int]):
        self.spark, self.path = spark, path
        self.first: dict[int, tuple[int, int]] = {}
        at = 0
        for part, n in sorted(sizes.items()):
            self.first[part] = (at, n)
            at += n
        self.rows = at

    @classmethod
    def write(cls, df: DataFrame, order: list[Column], path: str) -> Ranked:
        spark = df.sparkSession
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # The id of a row is its partition's number, then its place in the partition.
        sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        placed = sorted_.withColumn("_part", F.shiftright("_at", _BITS)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("_at")
        placed.write.parquet(path)
        sizes = spark.read.parquet(path).groupBy("_part").agg(F.count("*").alias("n")).collect()  # a row for each part
        return cls(spark, path, {r["_part"]: r["n"] for r in sizes})

    def slice(self, low: int, high: int) -> DataFrame:
        """Rows at the positions [low, high) in their order; only their parts are read."""
        found = F.lit(False)
        for part, (at, n) in self.first.items():
            a, b = max(low - at, 0), min(high - at, n)
            if a < b:
                found = found | ((F.col("_part") == part) & (F.col("_in") >= a) & (F.col("_in") < b))
        return self.spark.read.parquet(self.path).where(found).orderBy("_part", "_in").drop("_part", "_in")
