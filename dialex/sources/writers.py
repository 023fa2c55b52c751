"""Sinks: sorted tables, documents by key, small reports, and the cache that makes counting incremental."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.sources.scratch import exists


#: Rows of a Parquet page, which is what a read for one key touches at least.
PAGE_ROWS = 1000


def sorted_table(df: DataFrame, path: str, *keys: str, partitions: int | None = None, mode: str = "overwrite", page_rows: int = PAGE_ROWS, group_bytes: int = 32 << 20) -> None:
    """Parquet in ranges of the first two keys, sorted by all keys within a file, in small pages and row groups whose
    least and largest values let a read for a key skip nearly all others. Ranges of two keys also split a key that has a
    large share of the rows. Write the words once by film and once by word."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_files(df.repartitionByRange(n, *keys[:2]), path, *keys, mode=mode, page_rows=page_rows, group_bytes=group_bytes)


def sorted_files(df: DataFrame, path: str, *keys: str, mode: str = "overwrite", page_rows: int = PAGE_ROWS, group_bytes: int = 32 << 20) -> None:
    """`sorted_table` of rows that stay in the partitions they lie in: each file is sorted by all keys."""
    laid = df.sortWithinPartitions(*keys).write.mode(mode)
    laid.option("parquet.page.row.count.limit", page_rows).option("parquet.block.size", group_bytes).parquet(path)


def words_tables(words: DataFrame, path: str, beside: DataFrame | None = None) -> None:
    """The words in both orders: by film, most said first, and by word. The words of a film lie in one file; words that
    are dealt by film already, as those of a corpus, aren't shuffled for that. `beside` holds (film_id, ...), a row a
    film, and goes with the words in the second order."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_files(words.withColumn("_o", -F.col("count")).repartition(n, "film_id"), f"{path}/words_by_movie", "film_id", "_o", "word")
    sorted_table(words if beside is None else words.join(beside, "film_id", "left"), f"{path}/words_by_word", "word", "film_id")


def documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(key, payload) as JSON lines, one object a row; a file for each of millions of keys would only burden a store."""
    df.select(F.to_json(F.struct("key", "payload")).alias("value")).write.mode(mode).text(path, compression="gzip")


def selection_table(chosen: DataFrame, path: str) -> None:
    """Choices of files with their maps and arrays as JSON text."""
    columns = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in chosen.dtypes]
    chosen.select(*columns).write.mode("overwrite").parquet(path)


def small_json(df: DataFrame, most: int = 10_000) -> str:
    """A small result as a JSON array; more rows than `most` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write a table instead")
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, default=str)


class CountCache:
    """Counts by film and version, appended to; what is there for a film's present inputs isn't counted again. A row
    without a word marks a film as counted, so that one whose text has no words isn't read again either."""

    SCHEMA = "film_id string, version int, inputs long, word string, count long"

    def __init__(self, spark: SparkSession, path: str, version: int):
        self.spark, self.path, self.version = spark, path, version

    def _rows(self) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.SCHEMA)
        return rows.where(F.col("version") == self.version)

    def read(self) -> DataFrame:
        return self._rows().where("word IS NOT NULL")

    @staticmethod
    def inputs(*columns: str):
        """A stable key of what a film's counts depend on."""
        return F.xxhash64(F.to_json(F.struct(*sorted(columns))))

    def missing(self, docs: DataFrame) -> DataFrame:
        """docs(film_id, inputs, ...) that aren't in the cache with the same inputs."""
        return docs.join(self._rows().where("word IS NULL").select("film_id", "inputs"), ["film_id", "inputs"], "left_anti")

    def add(self, counts: DataFrame) -> None:
        counts.select("film_id", F.lit(self.version).alias("version"), "inputs", "word", "count").write.mode("append").parquet(self.path)

    def counts(self, docs: DataFrame) -> DataFrame:
        """The cached counts of these docs' present inputs."""
        return self.read().join(docs.select("film_id", "inputs"), ["film_id", "inputs"], "left_semi").select("film_id", "word", "count")
