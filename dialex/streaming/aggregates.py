"""Aggregates kept up to date: what a batch of documents changes is added to what is stored.

A batch says what its films' texts are now; a film that comes again replaces what it said before, and one whose text is
null is taken out. The difference between a film's old and new counts goes into two logs, by film and by (word, year),
each batch in a folder of its own: a batch that is run again writes the same folder again, and a folder counts only once
the batch is listed as done. Stored sums hold all words, so that one which crosses the floor in either direction needs no
second look at the texts; the floor is applied on reading. Compaction sums the folders of done batches into one.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dialex.functions import text
from dialex.sources.scratch import delete, exists, listed, put, scratch, text_of

#: What a batch has a row a film of; a film's last row by `turn` counts where it comes more than once.
DOCS = "film_id string, year int, text string, turn long"
SAID = "film_id string, year int, word string, count long, films long"
SUMS = "word string, year int, count long, films long"


class RunningAggregates:
    """Sums by (word, year) over all films so far, in a folder.

    The newest file in `done` lists the folders that count and the batches they stand for; it is put in place in one step,
    after everything that it names is written.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, compact_after: int = 16):
        self.spark, self.path, self.buckets, self.compact_after = spark, path.rstrip("/"), buckets, compact_after

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in listed(self.spark, f"{self.path}/done") if n.isdigit())

    def _done(self) -> dict:
        versions = self._versions()
        return json.loads(text_of(self.spark, f"{self.path}/done/{versions[-1]}")) if versions else {"folders": [], "batches": []}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("film_id"), F.lit(self.buckets)).cast("int")

    def _log(self, name: str, schema: str) -> DataFrame:
        parts = [f"{self.path}/{name}/{f}" for f in self._done()["folders"]]
        frames = [self.spark.read.schema(schema).parquet(p) for p in parts if exists(self.spark, p)]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows dealt by bucket and film: what is grouped by both then stays where it is, and a task writes to few
        folders. The number of partitions is stated, as texts become several times as many words after it."""
        return rows.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "film_id")

    def _change(self, texts: DataFrame, old: DataFrame) -> DataFrame:
        """(bucket, film_id, year, word, count, films): what texts(film_id, year, text) say now, less what the same films
        said. Texts are dealt, not their words; an old word goes with them, beside a text of one word."""
        now = texts.select("film_id", "year", self._bucket().alias("bucket"), "text", F.lit(None).cast("string").alias("_old"), *[F.lit(n).cast("long").alias(c) for c, n in (("_new", 1), ("_count", 1), ("_films", 0))])
        less = old.select("film_id", "year", "bucket", F.lit("old").alias("text"), F.col("word").alias("_old"), F.lit(0).cast("long").alias("_new"), (-F.col("count")).alias("_count"), (-F.col("films")).alias("_films"))
        words = text.token_rows(self._dealt(now.unionByName(less)), ("film_id", "year", "bucket", "_old", "_new", "_count", "_films"), "text").withColumn("word", F.coalesce("_old", "word"))
        change = words.groupBy("bucket", "film_id", "year", "word").agg(F.sum("_count").alias("count"), (F.max("_new") + F.sum("_films")).alias("films"))
        return change.where("count <> 0 OR films <> 0")

    def films(self) -> DataFrame:
        """(film_id, year, word, count) as they stand."""
        rows = self._log("films", SAID + ", bucket int").groupBy("film_id", "year", "word").agg(F.sum("count").alias("count"), F.sum("films").alias("films"))
        return rows.where("films > 0").drop("films")

    def add(self, docs: DataFrame, batch: int) -> None:
        """Takes in a batch of DOCS under its number. A batch that is done already is left alone."""
        done = self._done()
        if batch in done["batches"]:
            return
        folder = f"batch-{batch}"
        last = Window.partitionBy("film_id").orderBy(F.desc("turn"), F.desc("year"), F.desc("text"))
        latest = docs.where("film_id IS NOT NULL").withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
        path = scratch(self.spark, "batch")
        latest.write.parquet(path)
        latest = self.spark.read.schema(docs.schema).parquet(path)
        ids = latest.select("film_id", self._bucket().alias("bucket"))
        touched = [r.bucket for r in ids.select("bucket").distinct().collect()]  # `buckets` numbers at most
        old = self._log("films", SAID + ", bucket int").where(F.col("bucket").isin(touched)).join(ids, ["film_id", "bucket"], "left_semi")
        change = self._change(latest.where("text IS NOT NULL"), old)
        change.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/films/{folder}")
        written = self.spark.read.schema(SAID + ", bucket int").parquet(f"{self.path}/films/{folder}")
        self._sum(written).write.mode("overwrite").parquet(f"{self.path}/sums/{folder}")
        self._list([*done["folders"], folder], [*done["batches"], batch])
        if len(done["folders"]) + 1 >= self.compact_after:
            self.compact()

    def _list(self, folders: list[str], batches: list[int]) -> None:
        versions = self._versions()
        put(self.spark, f"{self.path}/done/{max(versions, default=0) + 1}", json.dumps({"folders": folders, "batches": batches}))
        for old in versions[:-1]:
            delete(self.spark, f"{self.path}/done/{old}")

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("word", "year").agg(F.sum("count").alias("count"), F.sum("films").alias("films"))
        return sums.where("count <> 0 OR films <> 0")

    def compact(self) -> None:
        """Sums the folders of done batches into one; the old ones are deleted once the new one is listed."""
        done = self._done()
        if len(done["folders"]) < 2:
            return
        folder = f"base-{max(done['batches'])}"
        rows = self._dealt(self._log("films", SAID + ", bucket int")).groupBy("bucket", "film_id", "year", "word").agg(F.sum("count").alias("count"), F.sum("films").alias("films"))
        films = rows.where("films > 0").withColumn("films", F.lit(1).cast("long"))
        films.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/films/{folder}")
        self._sum(self._log("sums", SUMS).repartitionByRange("word")).sortWithinPartitions("word", "year").write.mode("overwrite").parquet(f"{self.path}/sums/{folder}")
        self._list([folder], done["batches"])
        for old in done["folders"]:
            for name in ("films", "sums"):
                delete(self.spark, f"{self.path}/{name}/{old}")

    def word_year(self, floor: int = 20) -> DataFrame:
        """(word, year, count, movie_count) of words said `floor` times or more in films with a year."""
        rows = self._sum(self._log("sums", SUMS).repartition("word")).where("films > 0")  # totals need no further shuffle
        total = F.sum("count").over(Window.partitionBy("word"))
        return rows.withColumn("_t", total).where(F.col("_t") >= floor).select("word", "year", "count", F.col("films").alias("movie_count"))

    def dictionary(self) -> DataFrame:
        """(word, count, films) over all films, without a floor."""
        return self._log("sums", SUMS).groupBy("word").agg(F.sum("count").alias("count"), F.sum("films").alias("films")).where("films > 0")

    def year_totals(self) -> DataFrame:
        return self._log("sums", SUMS).groupBy("year").agg(F.sum("count").alias("total"), F.sum("films").alias("_f")).where("_f > 0").drop("_f")

    def stream(self, folder: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
        """Takes in the Parquet files (DOCS) of a folder as they come, until all of them are done. The stream's batch
        numbers are the batches', so one that is run again after a failure counts once."""
        docs = self.spark.readStream.schema(DOCS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        return docs.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
