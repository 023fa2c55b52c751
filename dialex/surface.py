"""The corpus for users who write SQL: published tables as views, and the common requests as table functions.

    SELECT * FROM trend('phone');
    SELECT m.title, s.count FROM saying('sword') s JOIN movies m USING (film_id);
    SELECT word, t.* FROM VALUES ('love'), ('war') AS asked(word), LATERAL trend(word) t;

Functions are SQL, so their plans are those of the queries that they stand for: arguments reach the scans as filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.operators import corpus
from dialex.sources import writers

VIEWS = ("movies", "words_by_movie", "words_by_word", "word_year", "word_meta", "dictionary", "year_totals")

#: How far a word's share in one text may be from its share in all, in Dirichlet prior words.
PRIOR = 100.0

FUNCTIONS = {
    "trend": """trend(asked STRING COMMENT 'a word') RETURNS TABLE (year INT, count BIGINT, films BIGINT, per_million DOUBLE)
COMMENT 'How often a word is said in each year; years without it have zeros.'
RETURN SELECT year, sum(count), sum(films), sum(count) * 1e6D / sum(total) FROM (
  SELECT year, count, movie_count AS films, 0L AS total FROM word_year WHERE word = lower(trim(asked)) UNION ALL SELECT year, 0L, 0L, total FROM year_totals) GROUP BY year""",
    "saying": """saying(asked STRING COMMENT 'a word') RETURNS TABLE (film_id {id}, count BIGINT, per_million DOUBLE)
COMMENT 'The films that say a word.'
RETURN SELECT m.film_id, w.count, w.count * 1e6D / m.total_words
FROM (SELECT film_id, count FROM words_by_word WHERE word = lower(trim(asked))) w JOIN movies m ON m.film_id = w.film_id""",
    "film": """film(asked {id} COMMENT 'a film', min_count BIGINT DEFAULT 3) RETURNS TABLE (word STRING, count BIGINT, films BIGINT, z DOUBLE)
COMMENT 'The words of a film, and by how many standard errors each is over its share in the corpus; rarer ones have no score.'
RETURN WITH own AS (SELECT word, count FROM words_by_movie WHERE film_id = asked),
n AS (SELECT sum(count) AS n FROM own), c AS (SELECT sum(count) AS n FROM dictionary),
k AS (SELECT own.word, own.count, d.count AS y, d.films, n.n, c.n AS nc, {prior}D * d.count / c.n AS pr FROM own JOIN dictionary d ON d.word = own.word, n, c)
SELECT word, count, films, CASE WHEN count >= min_count AND n + {prior}D - count - pr > 0 AND nc + {prior}D - y - pr > 0
  THEN (ln((count + pr) / (n + {prior}D - count - pr)) - ln((y + pr) / (nc + {prior}D - y - pr))) / sqrt(1 / (count + pr) + 1 / (y + pr)) END FROM k""",
    "compare": """compare(one {id} COMMENT 'a film', other {id} COMMENT 'another', min_count BIGINT DEFAULT 3) RETURNS TABLE (film_id {id}, word STRING, count BIGINT, ratio DOUBLE)
COMMENT 'The words that each of two films says more often than the other, at the same length; a word that the other lacks is taken at its rarest word''s rate.'
RETURN WITH w AS (SELECT film_id, word, count FROM words_by_movie WHERE film_id IN (one, other)),
r AS (SELECT w.film_id, w.word, w.count, w.count / n.n AS rate FROM w JOIN (SELECT film_id, sum(count) AS n FROM w GROUP BY film_id) n ON n.film_id = w.film_id),
f AS (SELECT film_id, min(rate) AS rate FROM r GROUP BY film_id)
SELECT a.film_id, a.word, a.count, a.rate / coalesce(b.rate, f.rate) FROM r a JOIN f ON f.film_id <> a.film_id LEFT JOIN r b ON b.film_id <> a.film_id AND b.word = a.word
WHERE a.count >= min_count AND a.rate > coalesce(b.rate, f.rate)""",
    "leaderboard": """leaderboard(language STRING DEFAULT NULL, genre STRING DEFAULT NULL, since INT DEFAULT NULL, until INT DEFAULT NULL) RETURNS TABLE (word STRING, count BIGINT, films BIGINT, kind STRING)
COMMENT 'Words by how often they are said, in all films or in those of a language, a genre and a stretch of years; kind is the part of speech.'
RETURN WITH chosen AS (SELECT film_id FROM movies WHERE (language IS NULL OR lang = language) AND (genre IS NULL OR array_contains(genres, genre))
  AND (since IS NULL OR year >= since) AND (until IS NULL OR year <= until)),
said AS (SELECT word, sum(count) AS count, count(*) AS films FROM words_by_movie w JOIN chosen ON chosen.film_id = w.film_id GROUP BY word)
SELECT said.word, said.count, said.films, coalesce(m.pos, 'x') FROM said LEFT JOIN word_meta m ON m.word = said.word""",
}


def write(films: DataFrame, words: DataFrame, meta: DataFrame, path: str, floor: int = 20) -> None:
    """Writes the tables that `publish` reads: the words in two orders, the others sorted by their keys. Words in their
    own order have their film's years beside them, and what is summed by word starts from there: few rows of a word are
    left in each file, and only those are shuffled."""
    writers.sorted_table(films, f"{path}/movies", "film_id")
    writers.words_tables(words, path, films.groupBy("film_id").agg(F.collect_list(F.struct("year")).alias("_years")))
    lain = words.sparkSession.read.parquet(f"{path}/words_by_word")
    lines = corpus.year_lines(lain.select("word", "count", F.inline("_years")), floor)
    writers.sorted_table(lines, f"{path}/word_year", "word", "year")
    writers.sorted_table(meta, f"{path}/word_meta", "word")
    writers.sorted_table(lain.groupBy("word").agg(F.sum("count").alias("count"), F.count("*").alias("films")), f"{path}/dictionary", "word")
    said = words.join(films.select("film_id", "year"), "film_id").where("year IS NOT NULL")
    said.groupBy("year").agg(F.sum("count").alias("total"), F.count_distinct("film_id").alias("films")).coalesce(1).write.mode("overwrite").parquet(f"{path}/year_totals")


def publish(spark: SparkSession, path: str) -> None:
    """Makes the tables of a folder views of the session, and the requests functions of it. A later call with another
    folder takes their place."""
    for name in VIEWS:
        spark.read.parquet(f"{path}/{name}").drop("_years").createOrReplaceTempView(name)
    kind = spark.table("movies").schema["film_id"].dataType.simpleString()
    for body in FUNCTIONS.values():
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION " + body.format(id=kind, prior=PRIOR))
