"""Exact de-duplication by content sort, in built-in functions only.

Texts are dealt out by range of their bytes and sorted, which places equal ones side by side; a streaming aggregate then
compares each text in full with its neighbour and keeps one id for a run of equal ones. The sampled splitters hold the
first bytes of a text and, for texts that begin alike, its hash: whole texts in splitters would send a share of the
corpus to the driver. Within a range the order is (first bytes, hash, whole text), so that equal texts are adjacent all
the same and long common beginnings are rarely compared. Texts that a large share of all rows hold are found first by
counting hashes into a fixed number of bins; they are aggregated where they are read and enter the sort as one row a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.llm.common import materialise, partitions, table

#: Leading bytes of a text in a splitter; bins for counting, and the most texts that can be hot.
PREFIX, BINS, HOT_TEXTS = 48, 1 << 16, 2048


def normalised(text: Column) -> Column:
    """The text as it is compared: unchanged, null as empty."""
    return F.coalesce(text, F.lit(""))


def _hot_hashes(digests: DataFrame, hot_texts: int, least: int) -> DataFrame:
    """Hashes that at least 1/hot_texts of the rows share, so at most hot_texts rows; never of fewer than `least` rows."""
    floor = max(digests.count() // hot_texts, least)
    binned = digests.select("h", F.pmod("h", F.lit(BINS)).alias("bin"))
    full = binned.groupBy("bin").agg(F.count("*").alias("n")).where(F.col("n") >= floor).select("bin")
    counted = binned.join(F.broadcast(full), "bin", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= floor).select("h")


def _classes(docs: DataFrame, hot: DataFrame, keep: str) -> DataFrame:
    """(sha, keep_id, group_size) of the texts that more than one row holds: the content sort."""
    pick = {"max": F.max, "min": F.min}[keep]
    text = normalised(F.col("text"))
    rows = docs.select(F.xxhash64(text).alias("h"), F.substring(F.encode(text, "UTF-8"), 1, PREFIX).alias("prefix"), text.alias("text"), "doc_id", F.lit(1).cast("long").alias("n"))
    cold = rows.join(F.broadcast(hot), "h", "left_anti")
    crowd = rows.join(F.broadcast(hot), "h", "left_semi").groupBy("h", "prefix", "text").agg(pick("doc_id").alias("doc_id"), F.sum("n").alias("n"))
    order = ["prefix", "h", "text"]
    ranged = cold.select(*order, "doc_id", "n").unionAll(crowd.select(*order, "doc_id", "n")).repartitionByRange(partitions(docs.sparkSession), "prefix", "h")
    # the aggregate's buffer holds a string, which Spark aggregates by streaming over the sorted rows, one text at a time
    runs = ranged.sortWithinPartitions(*order).groupBy(*order).agg(pick("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.max(F.sha2("text", 256)).alias("sha"))
    return runs.where("group_size > 1").select("sha", "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", hot_texts: int = HOT_TEXTS, least: int = 1000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of `docs`; order isn't kept.

    Texts are equal when their bytes are. Of equal texts the smallest id stays, or the largest with keep="max". A null
    text counts as empty, and empty texts are equal to each other. Rows without an id count in their group, and are
    kept only where no row of it has one, so that no text is lost. Rows that share id and text are one document, all
    with the same mark; rows that share an id only are told apart by text. An empty table gives an empty result. Other
    columns, whatever their names, aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    text = normalised(F.col("text"))
    digests = materialise(rows.select("doc_id", F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("h")), "digests")
    hot = materialise(_hot_hashes(digests, hot_texts, least), "hot-texts")
    classes = materialise(_classes(rows, hot, keep), "classes")
    hot_shas = digests.join(F.broadcast(hot), "h", "left_semi").groupBy("sha").agg(F.min("h").alias("h"))
    crowds = classes.join(F.broadcast(hot_shas), "sha").select("sha", "keep_id", "group_size")  # at most hot_texts rows
    of_crowd = digests.join(F.broadcast(hot), "h", "left_semi").join(F.broadcast(crowds), "sha", "left")
    others = digests.join(F.broadcast(hot), "h", "left_anti").join(classes, "sha", "left")
    found = of_crowd.select("doc_id", "sha", "keep_id", "group_size").unionAll(others.select("doc_id", "sha", "keep_id", "group_size"))
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the largest id that holds the same text, and how many do. Null and empty texts are equal; an
    empty table gives no row; what rows without an id and repeated rows give is said at `exact_duplicates`."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_exact_dedup": op12_exact_dedup}
ORACLES: dict[str, str] = {
    "op12_exact_dedup": """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
  FROM documents
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
       sha256(body) AS text_sha256
FROM t
"""
}
