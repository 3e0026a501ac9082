"""Document frequencies of all terms, written once so that a score needs no pass over the index."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..mapping import Index


def collect(index: Index, fields: list[str], path: str) -> TermStats:
    """Write (field, term, df), sorted so that a lookup reads few row groups, and per field
    the numbers of documents and tokens."""
    tokens = F.array(*[F.struct(F.lit(f).alias("field"), index.tokens(index.resolve(f)).alias("tokens")) for f in fields])
    each = index.df.select(F.inline(tokens))
    each.groupBy("field").agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens")).write.parquet(f"{path}/totals")
    df = each.select("field", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("field", "term").agg(F.count("*").alias("df"))
    df.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{path}/terms")
    return TermStats(index.df.sparkSession, path)


class TermStats:
    """Statistics that :func:`collect` has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def lookup(self, words: dict[str, list[str]]) -> tuple[dict[str, tuple[int, float]], dict[tuple[str, str], int]]:
        """Per field the number of documents and the mean length, and the words' frequencies."""
        totals = {r["field"]: (r["docs"], r["tokens"] / r["docs"] if r["docs"] else 0.0) for r in self.spark.read.parquet(f"{self.path}/totals").collect()}
        wanted = F.lit(False)
        for f, ws in words.items():
            wanted = wanted | ((F.col("field") == f) & F.col("term").isin(ws))
        found = {(r["field"], r["term"]): r["df"] for r in self.spark.read.parquet(f"{self.path}/terms").where(wanted).collect()}
        return totals, {(f, w): found.get((f, w), 0) for f, ws in words.items() for w in ws}
