"""Queries: cleaning and repair of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialex.functions import text
from dialex.plans.catalog import query
from dialex.plans.corpus import Corpus

_CLEAN = r"""t1 AS (SELECT page_id, i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS l FROM (SELECT page_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT page_id, string_split(html, chr(10)) AS ls FROM pages))),
t2 AS (SELECT page_id, i, regexp_replace(regexp_replace(regexp_replace(l, '<[^>]+>', ' ', 'g'), '\{\\[^}]*\}', ' ', 'g'), '(?i)&(?:nbsp|amp|quot|lt|gt|#\d+);|\bnbsp\b', ' ', 'g') AS l FROM t1),
t3 AS (SELECT * FROM t2 WHERE NOT regexp_matches(l, '(?i)subtitles?\s+by|subs\s+by|^\s*sync\w*\b.{0,20}?\bby\b|corrections?\s+by|encoded\s+by|opensubtitles|addic7ed|www\.|https?://|©|\w@\w') AND NOT regexp_matches(l, '[♪♫]|^\s*#')),
t4 AS (SELECT page_id, i, trim(regexp_replace(regexp_replace(regexp_replace(l, '[\[(][^\])]*[\])]', ' ', 'g'), '(?:^|\s)-\s+', ' ', 'g'), '\s+', ' ', 'g')) AS l FROM t3)"""


@query("strip_noise_lines", f"WITH {_CLEAN} SELECT page_id, count(*)::BIGINT AS lines, md5(string_agg(l, chr(10) ORDER BY i)) AS digest FROM t4 WHERE l <> '' GROUP BY page_id", base=False)
def strip_noise_lines(c: Corpus) -> DataFrame:
    lines = c.table("pages").select("page_id", text.clean_text(F.split("html", "\n")).alias("t")).where("t <> ''")
    return lines.select("page_id", F.size(F.split("t", "\n")).cast("long").alias("lines"), F.md5("t").alias("digest"))


@query("conversation_words", r"WITH w AS (SELECT conv_id, unnest(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}_'']+')) AS word FROM conversations) SELECT conv_id, word, count(*)::BIGINT AS count FROM w WHERE regexp_full_match(word, '[a-z'']+') AND (length(word) > 1 OR word IN ('a', 'i')) GROUP BY conv_id, word", base=False)
def conversation_words(c: Corpus) -> DataFrame:
    words = text.token_rows(c.table("conversations"), "conv_id", "text")
    return words.groupBy("conv_id", "word").agg(F.count("*").alias("count"))


@query("xml_sentences", r"SELECT doc_id, len(string_split(text, chr(10)))::INT AS sentences, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10))) AS content FROM documents")
def xml_sentences(c: Corpus) -> DataFrame:
    """Documents written as XML with a sentence a line, and read back."""
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<document>"), F.array_join(F.transform(F.split(escaped, "\n"), lambda x: F.concat(F.lit("<s>"), x, F.lit("</s>"))), ""), F.lit("</document>"))
    return c.table("documents").select("doc_id", text.xml_sentences(xml).alias("s")).select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "\n")).alias("content"))


@query("ocr_repair", """, d AS (SELECT film_id, CASE WHEN film_id % 3 = 0 AND word = 'in' THEN 'ln' WHEN film_id % 3 = 0 AND word = 'is' THEN 'ls' WHEN film_id % 3 = 0 AND word = 'it' THEN 'l''m' ELSE word END AS word, count FROM counts),
s AS (SELECT film_id, word, sum(count)::BIGINT AS count FROM d GROUP BY ALL), mk AS (SELECT film_id FROM s WHERE word = 'l''m' AND count >= 3)
SELECT film_id, word, sum(count)::BIGINT AS count, sum(fixed)::BIGINT AS repaired FROM (
  SELECT film_id, CASE WHEN m AND word = 'ln' THEN 'in' WHEN m AND word = 'ls' THEN 'is' ELSE word END AS word, count, CASE WHEN m AND word IN ('ln', 'ls') THEN count ELSE 0 END AS fixed
  FROM (SELECT *, film_id IN (SELECT film_id FROM mk) AS m FROM s)) GROUP BY film_id, word""")
def ocr_repair(c: Corpus) -> DataFrame:
    """Damages two common words in a third of the films, and repairs them."""
    third = F.col("film_id") % 3 == 0
    w = F.col("word")
    bad = c.counts.withColumn("word", F.when(third & (w == "in"), "ln").when(third & (w == "is"), "ls").when(third & (w == "it"), "l'm").otherwise(w)).groupBy("film_id", "word").agg(F.sum("count").alias("count"))
    zipf = c.spark.createDataFrame([("in", 6.0), ("is", 6.0), ("i'm", 2.0)], "word string, zipf double")
    return text.ocr_repair(bad, zipf)


@query("machine_translated_flags", "SELECT doc_id, (doc_id % 2)::INT AS flag FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 3 = 0", base=False)
def machine_translated_flags(c: Corpus) -> DataFrame:
    d = F.col("doc_id")
    raw = F.when(d % 3 == 0, "<s>no meta</s>").otherwise(F.concat(F.lit("<meta><machine_translated>9</machine_translated></meta><meta><machine_translated> "), (d % 2).cast("string"), F.lit(" </machine_translated></meta>")))
    return c.table("documents").select("doc_id", text.machine_translated_flag(raw).alias("flag"))


@query("film_ids_from_paths", "SELECT doc_id, 'tt' || CASE WHEN length(doc_id::VARCHAR) < 7 THEN lpad(doc_id::VARCHAR, 7, '0') ELSE doc_id::VARCHAR END AS film_id FROM documents", base=False)
def film_ids_from_paths(c: Corpus) -> DataFrame:
    path = F.concat(F.lit("OpenSubtitles/raw/en/1999/"), F.col("doc_id").cast("string"), F.lit("/12.xml"))
    return c.table("documents").select("doc_id", text.film_id_from_path(path).alias("film_id"))
