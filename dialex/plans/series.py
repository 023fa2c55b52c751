"""Queries: words over the years, slices by language and rating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialex.functions import stats
from dialex.operators import boards, corpus, slices, trends
from dialex.plans.catalog import query
from dialex.plans.corpus import Corpus

ASKED = ("the", "of", "there", "und", "zzz")
_IN = "('the', 'of', 'there', 'und', 'zzz')"
YL = ", yl AS (SELECT word, year, lang, sum(count)::BIGINT AS count, count(*)::BIGINT AS movie_count FROM words JOIN films USING (film_id) GROUP BY word, year, lang QUALIFY sum(sum(count)) OVER (PARTITION BY word, lang) >= 20)"


def by_language(c: Corpus) -> DataFrame:
    return c.word_year_lang


@query("word_year", "SELECT * FROM word_year")
def word_year(c: Corpus) -> DataFrame:
    return c.word_year


@query("word_year_lang", YL + " SELECT * FROM yl")
def word_year_lang(c: Corpus) -> DataFrame:
    return by_language(c)


@query("charted_semi", "SELECT * FROM words WHERE word IN (SELECT word FROM words GROUP BY word HAVING sum(count) >= 20)")
def charted_semi(c: Corpus) -> DataFrame:
    return trends.charted(c.words, c.word_year)


@query("trend_line", f"SELECT word, year, count FROM word_year WHERE word IN {_IN}")
def trend_line(c: Corpus) -> DataFrame:
    return trends.word_series(c.word_year, c.words, c.films, ASKED)


@query("trend_line_languages", f"SELECT word, year, sum(count)::BIGINT AS count FROM words JOIN films USING (film_id) WHERE word IN {_IN} AND lang IN ('de', 'fr') GROUP BY ALL")
def trend_line_languages(c: Corpus) -> DataFrame:
    return trends.word_series(c.word_year, c.words, c.films, ASKED, ("de", "fr"))


@query("trend_top15", "SELECT word, row_number() OVER (PARTITION BY word ORDER BY count DESC, title, film_id)::INT AS rank, film_id, title, year, count, total_words FROM words JOIN films USING (film_id) WHERE word IN (SELECT word FROM word_year) QUALIFY rank <= 15")
def trend_top15(c: Corpus) -> DataFrame:
    return trends.charted(trends.top_films(c.words, c.films), c.word_year)  # ranked first: few rows are left to be joined


@query("trend_by_year", "SELECT word, year, film_id, title, count FROM words JOIN films USING (film_id) WHERE word IN (SELECT word FROM word_year) QUALIFY row_number() OVER (PARTITION BY word, year ORDER BY count DESC, title, film_id) = 1")
def trend_by_year(c: Corpus) -> DataFrame:
    return trends.charted(trends.top_film_by_year(c.words, c.films), c.word_year)


@query("trend_files", "SELECT word, count(*)::INT AS years, sum(count)::BIGINT AS said FROM word_year GROUP BY word")
def trend_files(c: Corpus) -> DataFrame:
    files = trends.trend_files(c.word_year, c.words, c.films)
    return files.select("word", F.size("line").alias("years"), F.aggregate("line", F.lit(0).cast("long"), lambda a, x: a + x["count"]).alias("said"))


@query("year_totals", "SELECT year, sum(count)::BIGINT AS total FROM word_year GROUP BY year")
def year_totals(c: Corpus) -> DataFrame:
    return corpus.year_totals(c.word_year)


@query("year_totals_language", "SELECT year, sum(count)::BIGINT AS total FROM words JOIN films USING (film_id) WHERE lang = 'fr' GROUP BY year")
def year_totals_language(c: Corpus) -> DataFrame:
    return corpus.year_totals(c.words.join(c.films.where("lang = 'fr'").select("film_id", "year"), "film_id"))


@query("year_films", "SELECT year, count(*)::BIGINT AS films FROM films WHERE year IS NOT NULL GROUP BY year")
def year_films(c: Corpus) -> DataFrame:
    return corpus.year_films(c.films)


@query("genre_films_per_year", "SELECT year, count(*)::BIGINT AS films FROM films WHERE list_contains(genres, 'src3') AND (year // 10) * 10 = 1990 GROUP BY year")
def genre_films_per_year(c: Corpus) -> DataFrame:
    return corpus.films_per_year(c.films, "src3", 1990)


_TOTALS = ", yt AS (SELECT year, sum(count)::BIGINT AS total FROM word_year GROUP BY year)"


@query("rate_series", _TOTALS + f" SELECT w.word, yt.year, coalesce(y.count, 0) / yt.total::DOUBLE * 1e6 AS rate FROM (SELECT DISTINCT word FROM word_year WHERE word IN {_IN}) w CROSS JOIN (SELECT * FROM yt WHERE total >= 500) yt LEFT JOIN word_year y ON y.word = w.word AND y.year = yt.year")
def rate_series(c: Corpus) -> DataFrame:
    return trends.series(c.word_year, corpus.year_totals(c.word_year), ASKED, 500)


_YF = ", yf AS (SELECT year, count(*)::BIGINT AS films FROM films GROUP BY year)"


@query("per_film_series", _YF + f" SELECT word, year, count / films::DOUBLE AS per_film FROM word_year JOIN yf USING (year) WHERE word IN {_IN}")
def per_film_series(c: Corpus) -> DataFrame:
    return trends.per_film_series(c.word_year, corpus.year_films(c.films), ASKED)


@query("per_film_summary", _YF + f" SELECT word, sum(count) FILTER (year > (SELECT max(year) FROM yf) - 10) / (SELECT sum(films) FROM yf WHERE year > (SELECT max(year) FROM yf) - 10)::DOUBLE AS latest, sum(count) / (SELECT sum(films) FROM yf)::DOUBLE AS overall FROM word_year WHERE word IN {_IN} GROUP BY word")
def per_film_summary(c: Corpus) -> DataFrame:
    return trends.per_film_summary(c.word_year, corpus.year_films(c.films), ASKED)


@query("year_ranges", "SELECT word, min(year)::INT AS first, max(year)::INT AS last FROM (SELECT word, year, year - row_number() OVER (PARTITION BY word ORDER BY year) AS i FROM word_year) GROUP BY word, i")
def year_ranges(c: Corpus) -> DataFrame:
    return trends.year_ranges(c.word_year)


@query("featured_lines", f"SELECT word, year, count FROM word_year WHERE word IN {_IN} UNION ALL SELECT '', year, sum(count)::BIGINT FROM word_year GROUP BY year")
def featured_lines(c: Corpus) -> DataFrame:
    totals = corpus.year_totals(c.word_year).select(F.lit("").alias("word"), "year", F.col("total").alias("count"))
    return trends.word_series(c.word_year, c.words, c.films, ASKED).unionByName(totals)


@query("language_manifest", "SELECT lang AS code, count(*)::BIGINT AS films FROM films GROUP BY lang HAVING count(*) >= 100")
def language_manifest(c: Corpus) -> DataFrame:
    return corpus.language_manifest(c.films)


@query("lang_slice_word_year", YL + " SELECT word, year, sum(count)::BIGINT AS count, sum(movie_count)::BIGINT AS movie_count FROM yl WHERE lang = 'es' GROUP BY word, year QUALIFY sum(sum(count)) OVER (PARTITION BY word) >= 20")
def lang_slice_word_year(c: Corpus) -> DataFrame:
    return slices.language_slice(c.films, c.words, by_language(c), "es")["word_year"]


@query("lang_slice_leaderboard", "SELECT word, sum(count)::BIGINT AS count, count(*)::BIGINT AS films FROM words JOIN films USING (film_id) WHERE lang = 'es' GROUP BY word ORDER BY 2 DESC, 1 LIMIT 1000")
def lang_slice_leaderboard(c: Corpus) -> DataFrame:
    return boards.leaderboard(slices.language_slice(c.films, c.words, by_language(c), "es")["words"])


_RATED = ", rf AS (SELECT * FROM films WHERE year >= 1968 AND film_id IN (SELECT film_id FROM ratings WHERE rating IN ('r', 'nc17')))"


@query("rating_slice_films", _RATED + " SELECT film_id, title, year FROM rf")
def rating_slice_films(c: Corpus) -> DataFrame:
    return slices.rating_slice(c.films, c.words, c.ratings, "r")["films"].select("film_id", "title", "year")


@query("rating_slice_word_year", _RATED + " SELECT word, year, sum(count)::BIGINT AS count, count(*)::BIGINT AS movie_count FROM words JOIN rf USING (film_id) GROUP BY word, year QUALIFY sum(sum(count)) OVER (PARTITION BY word) >= 20")
def rating_slice_word_year(c: Corpus) -> DataFrame:
    return slices.rating_slice(c.films, c.words, c.ratings, "r")["word_year"]


_SLICES = """, sl AS (SELECT 'global' AS slice, film_id FROM films UNION ALL SELECT 'lang:' || lang, film_id FROM films
 UNION ALL SELECT 'rating:' || CASE rating WHEN 'nc17' THEN 'r' ELSE rating END, film_id FROM films JOIN ratings USING (film_id) WHERE year >= 1968)"""


@query("all_slices", _SLICES + " SELECT slice, count(*)::BIGINT AS films FROM sl GROUP BY slice")
def all_slices(c: Corpus) -> DataFrame:
    return slices.all_slices(c.films, c.ratings).groupBy("slice").agg(F.count("*").alias("films"))


@query("sliced_word_year", _SLICES + " SELECT word, year, slice, sum(count)::BIGINT AS count, count(*)::BIGINT AS movie_count FROM words JOIN sl USING (film_id) JOIN films USING (film_id) GROUP BY word, year, slice QUALIFY sum(sum(count)) OVER (PARTITION BY word, slice) >= 20")
def sliced_word_year(c: Corpus) -> DataFrame:
    return slices.sliced_word_year(c.words, c.films, slices.all_slices(c.films, c.ratings))


@query("merge_trend_lines", YL + f" SELECT word, year, sum(count)::BIGINT AS count FROM yl WHERE lang IN ('en', 'de') AND word IN {_IN} GROUP BY ALL")
def merge_trend_lines(c: Corpus) -> DataFrame:
    rows = by_language(c).where(F.col("word").isin(*ASKED))
    return slices.merge_by_year([rows.where(F.col("lang") == lang).select("word", "year", "count") for lang in ("en", "de")], "count", ("word",))


@query("merge_year_totals", YL + " SELECT year, sum(count)::BIGINT AS total FROM yl WHERE lang IN ('en', 'de') GROUP BY year")
def merge_year_totals(c: Corpus) -> DataFrame:
    return slices.merge_by_year([corpus.year_totals(by_language(c).where(F.col("lang") == lang)) for lang in ("en", "de")], "total")


_TOP = "SELECT * FROM (SELECT {p} AS p, film_id, title, year, count FROM words JOIN films USING (film_id) WHERE word = 'the' AND lang = '{lang}' ORDER BY count DESC, title, film_id LIMIT 15)"


@query("merge_top_films", f"SELECT film_id, title, year, count FROM ({_TOP.format(p=0, lang='en')} UNION ALL {_TOP.format(p=1, lang='de')}) ORDER BY count DESC, p, film_id LIMIT 15")
def merge_top_films(c: Corpus) -> DataFrame:
    said = c.words.where("word = 'the'")
    return slices.merge_top_films([trends.top_films(said, c.films.where(F.col("lang") == lang)).select("film_id", "title", "year", "count") for lang in ("en", "de")])


_SHIFT = """SELECT word, round(log2((coalesce(sum(rate) FILTER (decade IN (2010, 2020)), 0) / 2 + 0.1) / (coalesce(sum(rate) FILTER (decade IN (1930, 1940)), 0) / 2 + 0.1)), 2) AS score
  FROM (SELECT decade, word, c / sum(c) OVER (PARTITION BY decade)::DOUBLE * 1e6 AS rate, sum(c) OVER (PARTITION BY word) AS n, count(*) OVER (PARTITION BY word) AS d
        FROM (SELECT (year // 10) * 10 AS decade, word, sum(count)::BIGINT AS c FROM yl WHERE lang = '{lang}' AND year BETWEEN 1930 AND 2029 GROUP BY ALL))
  WHERE n >= 100 AND d >= 4 GROUP BY word ORDER BY score DESC, word LIMIT 30"""


@query("merge_shifts", YL + f", p AS (SELECT *, 0 AS p FROM ({_SHIFT.format(lang='en')}) UNION ALL SELECT *, 1 FROM ({_SHIFT.format(lang='fr')})) SELECT word, score FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY abs(score) DESC, p) = 1 ORDER BY abs(score) DESC, word LIMIT 30")
def merge_shifts(c: Corpus) -> DataFrame:
    def part(lang: str) -> DataFrame:
        scored = boards.shifts(by_language(c).where(F.col("lang") == lang), 100, 4)
        return scored.orderBy(F.desc("score"), "word").limit(30).select("word", "score")

    return slices.merge_shifts([part("en"), part("fr")])


@query("trend_file_lines", "SELECT word, year, count FROM word_year")
def trend_file_lines(c: Corpus) -> DataFrame:
    return trends.file_lines(trends.trend_files(c.word_year, c.words, c.films))


_CHARTED = ", ch AS (SELECT words.*, title, year, total_words, lang FROM words JOIN (SELECT DISTINCT word FROM word_year) USING (word) JOIN films USING (film_id))"


@query("trend_file_top", _CHARTED + " SELECT word, row_number() OVER (PARTITION BY word ORDER BY count DESC, title, film_id)::INT AS rank, film_id, title, year, count, total_words FROM ch QUALIFY rank <= 15")
def trend_file_top(c: Corpus) -> DataFrame:
    return trends.file_top_films(trends.trend_files(c.word_year, c.words, c.films))


@query("trend_file_by_year", _CHARTED + " SELECT word, year, film_id, title, count FROM ch QUALIFY row_number() OVER (PARTITION BY word, year ORDER BY count DESC, title, film_id) = 1")
def trend_file_by_year(c: Corpus) -> DataFrame:
    return trends.file_by_year(trends.trend_files(c.word_year, c.words, c.films))


def _merged_files(c: Corpus) -> DataFrame:
    of = lambda t, lang: t.where(F.col("lang") == lang)
    return slices.merge_trend_files([trends.trend_files(of(by_language(c), lang), c.words, of(c.films, lang)) for lang in ("en", "de")])


_PARTS = YL + """, tw AS (SELECT w.film_id, w.word, w.count, f.title, f.year, f.total_words, f.lang, (f.lang = 'de')::INT AS part FROM words w JOIN films f USING (film_id)
  JOIN (SELECT DISTINCT lang, word FROM yl WHERE lang IN ('en', 'de')) k ON k.lang = f.lang AND k.word = w.word)"""


@query("merge_trend_file_lines", YL + " SELECT word, year, sum(count)::BIGINT AS count FROM yl WHERE lang IN ('en', 'de') GROUP BY ALL")
def merge_trend_file_lines(c: Corpus) -> DataFrame:
    return trends.file_lines(_merged_files(c))


@query("merge_trend_file_top", _PARTS + """, t15 AS (SELECT *, row_number() OVER (PARTITION BY part, word ORDER BY count DESC, title, film_id) AS r FROM tw QUALIFY r <= 15)
SELECT word, row_number() OVER (PARTITION BY word ORDER BY count DESC, part, r)::INT AS rank, film_id, title, year, count, total_words FROM t15 QUALIFY rank <= 15""")
def merge_trend_file_top(c: Corpus) -> DataFrame:
    return trends.file_top_films(_merged_files(c))


@query("merge_trend_file_by_year", _PARTS + """, ty AS (SELECT * FROM tw QUALIFY row_number() OVER (PARTITION BY part, word, year ORDER BY count DESC, title, film_id) = 1)
SELECT word, year, film_id, title, count FROM ty QUALIFY row_number() OVER (PARTITION BY word, year ORDER BY count DESC, part) = 1""")
def merge_trend_file_by_year(c: Corpus) -> DataFrame:
    return trends.file_by_year(_merged_files(c))


_FEATURED = YL + f", fe AS (SELECT word, year, count FROM yl WHERE lang IN ('en', 'de') AND word IN {_IN} UNION ALL SELECT '', year, count FROM yl WHERE lang IN ('en', 'de'))"


@query("merge_featured", _FEATURED + " SELECT word, year, sum(count)::BIGINT AS count FROM fe GROUP BY ALL")
def merge_featured(c: Corpus) -> DataFrame:
    def part(lang: str) -> DataFrame:
        rows = by_language(c).where(F.col("lang") == lang)
        totals = corpus.year_totals(rows).select(F.lit("").alias("word"), "year", F.col("total").alias("count"))
        return rows.where(F.col("word").isin(*ASKED)).select("word", "year", "count").unionByName(totals)

    return slices.merge_featured([part("en"), part("de")])


@query("shift_ratios", YL + f" SELECT word, score, round(pow(2.0, abs(score)), 6) AS ratio FROM ({_SHIFT.format(lang='en')})")
def shift_ratios(c: Corpus) -> DataFrame:
    scored = boards.shifts(by_language(c).where(F.col("lang") == "en"), 100, 4).orderBy(F.desc("score"), "word").limit(30)
    return scored.select("word", "score", F.round(stats.shift_ratio(F.col("score")), 6).alias("ratio"))


_RATE = "count / greatest(total_words, 1)::DOUBLE * 1000"


@query("rate_labels", f"SELECT film_id, word, CASE WHEN {_RATE} < 0.1 THEN '<0.1' ELSE regexp_replace(printf('%.1f', round({_RATE}, 1)), '\\.0$', '') END AS per_1k, CASE WHEN count / 7.0::DOUBLE >= 1 THEN printf('%.1f', round(count / 7.0::DOUBLE, 1)) ELSE printf('%.2f', round(count / 7.0::DOUBLE, 2)) END AS per_film FROM words JOIN films USING (film_id) WHERE word IN {_IN}")
def rate_labels(c: Corpus) -> DataFrame:
    said = c.words.where(F.col("word").isin(*ASKED)).join(c.films.select("film_id", "total_words"), "film_id")
    return said.select("film_id", "word", stats.per_1k_label(F.col("count"), F.col("total_words")).alias("per_1k"), stats.per_film_label(F.col("count") / 7).alias("per_film"))
