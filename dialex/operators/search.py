"""Substring search by an index of trigrams.

Postings are rows (gram, id) sorted by gram and id and written so that the file format stores ids as differences; a search
reads the pages of its grams, keeps the ids that all of a pattern's grams have, and verifies those against the texts. No
posting list is ever held as one value, so a gram that a third of all texts hold is no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.functions import text
from dialex.sources.writers import PAGE_ROWS

GRAM = 3


def normalised(value: Column) -> Column:
    return F.lower(F.trim(value))


def grams(value: Column) -> Column:
    """The distinct trigrams of a text; none of shorter ones."""
    at = F.sequence(F.lit(1), F.length(value) - (GRAM - 1))
    return F.when(F.length(value) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substr(value, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


class TrigramIndex:
    """An index in a folder, of texts with ids."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, texts: DataFrame) -> None:
        """Indexes texts(id, text), ids whole numbers that come once each; null texts are left out."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        known = texts.where("text IS NOT NULL AND id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text", normalised(F.col("text")).alias("norm"))
        base = F.when(text.is_stretched(F.col("norm")), text.collapse(F.col("norm")))
        laid = known.withColumn("base", base).repartitionByRange(n, "id").sortWithinPartitions("id")
        laid.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/texts")
        rows = self._texts().select(F.explode(grams(F.col("norm"))).alias("gram"), "id").repartitionByRange(n, "gram", "id").sortWithinPartitions("gram", "id")
        # ids aren't worth a dictionary; without one the second version of the format stores their differences
        out = rows.write.mode("overwrite").option("parquet.writer.version", "v2").option("parquet.enable.dictionary#id", "false")
        out.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/postings")

    def _texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def postings(self, wanted: list[str]) -> DataFrame:
        """(gram, id) of some grams; the filter reaches the file's page statistics."""
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("gram").isin(wanted))

    def candidates(self, pattern: str) -> DataFrame:
        """(id) of the texts that hold all trigrams of a pattern of three characters or more."""
        q = pattern.strip().lower()
        wanted = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
        return self.postings(wanted).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("id")

    def find(self, pattern: str, stretched: bool = False) -> DataFrame:
        """(id, text) of the texts that hold a pattern, whatever the case; with `stretched` also words that are the
        pattern with letters drawn out (sooo for so). An empty pattern is in every text, and patterns under three
        characters are looked for in all texts."""
        q = pattern.strip().lower()
        rows = self._texts()
        near = rows.join(self.candidates(q), "id", "left_semi") if len(q) >= GRAM else rows
        found = near.where(F.col("norm").contains(q))
        if stretched and q:
            found = found.unionByName(rows.where((F.col("base") == text.collapse(F.lit(q))) & ~F.col("norm").contains(q)))
        return found.select("id", "text")

    def find_all(self, patterns: DataFrame) -> DataFrame:
        """(pattern, id, text) for many patterns(pattern) at once. Each short pattern is looked for in all texts, so the
        short ones should be few."""
        asked = patterns.where("pattern IS NOT NULL").select("pattern", normalised(F.col("pattern")).alias("q")).distinct()
        long, few = asked.where(F.length("q") >= GRAM), asked.where(F.length("q") < GRAM)
        parts = long.select("q", F.explode(grams(F.col("q"))).alias("gram")).distinct()
        postings = self.spark.read.parquet(f"{self.path}/postings")
        sizes = postings.groupBy("gram").agg(F.count("*").alias("size"))
        # a pattern's rarest gram alone decides which texts are looked at; a pattern with a gram that no text has is in none
        rated = parts.join(sizes, "gram", "left")
        rarest = rated.groupBy("q").agg(F.min(F.struct(F.coalesce("size", F.lit(0)).alias("size"), "gram")).alias("r")).where("r.size > 0")
        near = rarest.select("q", F.col("r.gram").alias("gram")).join(postings, "gram").select("q", "id")
        found = near.join(self._texts(), "id").where(F.col("norm").contains(F.col("q")))
        rest = self._texts().join(F.broadcast(few.select("q").distinct()), F.col("norm").contains(F.col("q")))
        every = found.select("q", "id", "text").unionByName(rest.select("q", "id", "text"))
        return asked.join(every, "q").select("pattern", "id", "text")
