"""Line de-duplication with keep bitmaps, in built-in functions only.

Line keys are hashed to 128 bits, dealt out by range of the hash and sorted by (hash, document, position), so that one
running window streams each key's first document past its later ones. Keys that hold a large share of all lines are
found first by counting into a fixed number of bins; they are worked off where they are read, against a broadcast table
whose size is bounded by their share. The result is a bitmap per document, not text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialex.llm.common import columns, materialise, partitions, table, unused

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bins for counting, and the most keys that can be hot: a hot key has at least 1/HOT_KEYS of all lines.
BINS, HOT_KEYS = 1 << 16, 2048


def lines_of(text: Column) -> Column:
    """The lines of a text; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _hashed(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    keyed = rows.select("doc_id", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _hot_keys(lines: DataFrame, hot_keys: int, least: int = 1000) -> DataFrame:
    """(h1, h2, first) of the keys with at least 1/hot_keys of the lines; so at most hot_keys rows. Keys of fewer than
    `least` lines are never hot: any task holds so many."""
    total = lines.count()
    floor = max(total // hot_keys, least)
    bins = lines.groupBy(F.pmod("h1", F.lit(BINS)).alias("bin")).agg(F.count("*").alias("n")).where(F.col("n") >= floor).select("bin")
    within = lines.withColumn("bin", F.pmod("h1", F.lit(BINS))).join(F.broadcast(bins), "bin", "left_semi")
    return within.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= floor).drop("n")


def drop_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", hot_keys: int = HOT_KEYS) -> DataFrame:
    """(doc_id, n_dropped, bits) for documents that lose lines: `bits` maps a 64-line word's number to the bits of the
    lines that go, and holds no word without one.

    A key of at least `min_chars` code points goes from all documents but the one with the smallest id; there all its
    lines stay. Rows with a null id neither lose lines nor count as holders; rows that share an id are one document and
    should hold the same text.
    """
    lines = materialise(_hashed(docs, id_col, text_col, min_chars), "lines")
    hot = materialise(_hot_keys(lines, hot_keys), "hot")
    cold = lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
    ranged = cold.repartitionByRange(partitions(docs.sparkSession), "h1").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    running = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = ranged.withColumn("first", F.first("doc_id").over(running)).where("doc_id > first").select("doc_id", "pos")
    later = later.unionAll(lines.join(F.broadcast(hot), ["h1", "h2"]).where("doc_id > first").select("doc_id", "pos"))
    words = later.groupBy("doc_id", F.expr("pos div 64").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("mask"))
    return words.groupBy("doc_id").agg(F.sum(F.bit_count("mask")).alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("bits"))


def kept_text(text: Column, bits: Column) -> Column:
    """The text without the lines marked in `bits` (null: all stay)."""

    def stays(_: Column, i: Column) -> Column:
        mask = F.coalesce(F.try_element_at(bits, F.shiftright(i, 6)), F.lit(0).cast("long"))
        return F.getbit(mask, F.pmod(i, F.lit(64))) == 0

    return F.when(bits.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines_of(text), stays), "\n"))


OUT = ("_kept", "_n_lines", "_n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", hot_keys: int = HOT_KEYS, out: tuple[str, str, str] = OUT) -> DataFrame:
    """All rows and columns of `docs`, and three columns named in `out`: the text that is left, the lines before, and
    the lines dropped; order isn't kept.

    A null text counts as empty: one line, which stays. What null and shared ids mean is said at `drop_bitmaps`; an
    empty table gives an empty result. Other columns may have any names but those in `out`.
    """
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in out}:
        raise ValueError(f"{sorted(clash)}: choose other names in `out`")
    found = drop_bitmaps(docs, min_chars, id_col, text_col, hot_keys)
    key, gone, bits = (unused(docs.columns, c) for c in ("_id", "_gone", "_bits"))
    joined = docs.join(found.select(F.col("doc_id").alias(key), F.col("n_dropped").alias(gone), F.col("bits").alias(bits)), docs[id_col] == F.col(key), "left")
    text = docs[text_col]
    done = [kept_text(text, F.col(bits)), F.size(lines_of(text)).cast("long"), F.coalesce(F.col(gone), F.lit(0)).cast("long")]
    return joined.select(*columns(docs), *[c.alias(n) for c, n in zip(done, out, strict=True)])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document and the hash of what is left. Null and empty texts are one empty line, which
    stays; rows without an id lose nothing; an empty table gives no row."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_line_dedup": op7_line_dedup}
ORACLES: dict[str, str] = {
    "op7_line_dedup": """
WITH l AS (
  SELECT doc_id, line, i,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), k AS (
  SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT l.doc_id, l.line, l.i, k.key IS NOT NULL AND l.doc_id > k.first AS gone FROM l LEFT JOIN k ON l.key = k.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
}
