"""Incremental counting: files of documents arrive in a folder, each batch is counted once and added to the cache.

The batch step is the batch pipeline's own: an anti-join against the cache, so a batch that is run again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dialex.functions import text
from dialex.sources.scratch import delete, exists, listed
from dialex.sources.writers import CountCache

DOCS = "film_id string, text string"


def count_new(cache: CountCache, docs: DataFrame) -> None:
    """Counts the documents that the cache lacks, and marks each with a null word, in one write."""
    keyed = docs.where("film_id IS NOT NULL").withColumn("inputs", cache.inputs("text"))
    new = cache.missing(keyed).dropDuplicates(["film_id", "inputs"])
    words = text.token_rows(new.withColumn("_film", F.struct("film_id", "inputs")), "_film", "text").select("_film.film_id", "_film.inputs", "word")
    marks = new.select("film_id", "inputs", F.lit(None).cast("string").alias("word"))
    cache.add(words.unionByName(marks).groupBy("film_id", "inputs", "word").agg(F.count("*").alias("count")))


def count_stream(spark: SparkSession, folder: str, cache: CountCache, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Watches a folder of Parquet files of (film_id, text), and counts what comes until all of it is done."""
    docs = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return docs.writeStream.foreachBatch(lambda df, _: count_new(cache, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(spark: SparkSession, folder: str, path: str, checkpoint: str) -> StreamingQuery:
    """Word totals over all documents so far, as Parquet. Each batch writes a version of its own, in path/version=<batch>,
    and then deletes those before the last: a write that fails leaves the versions that were there. `totals` reads the
    newest whole one. Films that change and are taken out need `RunningAggregates`."""
    docs = spark.readStream.schema(DOCS).parquet(folder)
    words = text.token_rows(docs, "film_id", "text").groupBy("word").agg(F.count("*").alias("count"))

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/version={batch}")
        for name in _versions(spark, path)[:-2]:
            delete(spark, f"{path}/{name}")

    return words.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Whole versions, the newest last."""
    names = [n for n in listed(spark, path) if n.startswith("version=") and exists(spark, f"{path}/{n}/_SUCCESS")]
    return sorted(names, key=lambda n: int(n.partition("=")[2]))


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(word, count) as the last whole batch left them."""
    return spark.read.parquet(f"{path}/{_versions(spark, path)[-1]}")
