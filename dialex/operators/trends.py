"""Words over the years."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialex.functions.stats import per_million


def charted(words: DataFrame, word_year: DataFrame) -> DataFrame:
    """Words that have a yearly line."""
    return words.join(word_year.select("word").distinct(), "word", "left_semi")


def _said(words: DataFrame, films: DataFrame) -> DataFrame:
    return words.join(films.select("film_id", "title", "year", "total_words"), "film_id")


def top_films(words: DataFrame, films: DataFrame, top: int = 15) -> DataFrame:
    """(word, rank, film_id, title, year, count, total_words): the films that say a word most."""
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("count"), "title", "film_id"))
    return _said(words, films).withColumn("rank", rank).where(F.col("rank") <= top).select("word", "rank", "film_id", "title", "year", "count", "total_words")


def top_film_by_year(words: DataFrame, films: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("word", "year").orderBy(F.desc("count"), "title", "film_id"))
    return _said(words, films).withColumn("_r", rank).where("_r = 1").select("word", "year", "film_id", "title", "count")


def trend_files(word_year: DataFrame, words: DataFrame, films: DataFrame, top: int = 15) -> DataFrame:
    """A row a word: its line, its top films and the top film of each year, as sorted arrays of structs."""
    rows = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    line = word_year.groupBy("word").agg(rows("year", "count").alias("line"))
    best = top_films(words, films, top).groupBy("word").agg(rows("rank", "film_id", "title", "year", "count", "total_words").alias("top"))
    yearly = top_film_by_year(words, films).groupBy("word").agg(rows("year", "film_id", "title", "count").alias("by_year"))
    return line.join(best, "word", "left").join(yearly, "word", "left")


def file_lines(files: DataFrame) -> DataFrame:
    """(word, year, count) of trend files: their lines as rows again."""
    return files.select("word", F.inline("line"))


def file_top_films(files: DataFrame) -> DataFrame:
    """(word, rank, film_id, title, year, count, total_words) of trend files."""
    return files.select("word", F.inline("top"))


def file_by_year(files: DataFrame) -> DataFrame:
    """(word, year, film_id, title, count) of trend files."""
    return files.select("word", F.inline("by_year"))


def series(word_year: DataFrame, totals: DataFrame, words: Iterable[str], min_total: int = 100_000) -> DataFrame:
    """(word, year, rate): rates per million in the years with enough words; 0 where a charted word wasn't said."""
    asked = word_year.where(F.col("word").isin(*words))
    years = totals.where(F.col("total") >= min_total)
    grid = asked.select("word").distinct().join(years, F.lit(True))
    counts = asked.select("word", "year", "count")
    return grid.join(counts, ["word", "year"], "left").select("word", "year", per_million(F.coalesce("count", F.lit(0)), F.col("total")).alias("rate"))


def missing_words(word_year: DataFrame, words: Iterable[str]) -> list[str]:
    """Of the words asked for, those without a line."""
    words = list(words)
    found = {r.word for r in word_year.where(F.col("word").isin(*words)).select("word").distinct().collect()}
    return [w for w in words if w not in found]


def per_film_series(word_year: DataFrame, films_by_year: DataFrame, words: Iterable[str]) -> DataFrame:
    """(word, year, per_film): how often a film of the year says the word."""
    asked = word_year.where(F.col("word").isin(*words)).select("word", "year", "count")
    return asked.join(films_by_year, "year").select("word", "year", (F.col("count") / F.nullif("films", F.lit(0))).alias("per_film"))


def per_film_summary(word_year: DataFrame, films_by_year: DataFrame, words: Iterable[str], last: int = 10) -> DataFrame:
    """(word, latest, overall): pooled means over the latest years and over all years of the films table."""
    words = list(words)
    span = films_by_year.agg(F.max("year").alias("end"), F.sum("films").alias("films_all"))
    late_films = films_by_year.crossJoin(span).where(F.col("year") > F.col("end") - last).agg(F.sum("films").alias("films_late"))
    rows = word_year.where(F.col("word").isin(*words)).crossJoin(span).groupBy("word", "films_all").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("year") > F.col("end") - last, F.col("count")).otherwise(0)).alias("late"))
    return rows.crossJoin(late_films).select("word", (F.col("late") / F.col("films_late")).alias("latest"), (F.col("n") / F.col("films_all")).alias("overall"))


def year_ranges(years: DataFrame, key: str = "word") -> DataFrame:
    """(key, first, last): runs of consecutive years."""
    island = F.col("year") - F.row_number().over(Window.partitionBy(key).orderBy("year"))
    return years.select(key, "year").distinct().withColumn("_i", island).groupBy(key, "_i").agg(F.min("year").alias("first"), F.max("year").alias("last")).drop("_i")


def word_series(word_year: DataFrame, words: DataFrame, films: DataFrame, asked: Iterable[str], langs: Iterable[str] = ()) -> DataFrame:
    """(word, year, count) for a list of words: from the yearly table, or with languages from the films' words."""
    from dialex.functions.predicates import in_languages

    if not (langs := tuple(langs)):
        return word_year.where(F.col("word").isin(*asked)).select("word", "year", "count")
    chosen = films.where(in_languages(F.col("lang"), langs)).select("film_id", "year")
    return words.where(F.col("word").isin(*asked)).join(chosen, "film_id").groupBy("word", "year").agg(F.sum("count").alias("count"))


def films_since(films_by_year: DataFrame, year: int) -> DataFrame:
    """(films): how many films are of a year or later; 0 where there are none."""
    return films_by_year.where(F.col("year") >= year).agg(F.coalesce(F.sum("films"), F.lit(0)).alias("films"))


def top_film_rows(years: DataFrame, best: DataFrame, words: Iterable[str]) -> DataFrame:
    """(word, year, film_id, title, count): a row for each of years(year) and each word, null where the year has no film
    that says it, so that no year is left out. best as `top_film_by_year` gives it."""
    asked = years.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string")
    grid = years.select("year").distinct().join(F.broadcast(asked), F.lit(True))  # the words of a request, a few
    return grid.join(best.select("word", "year", "film_id", "title", "count"), ["word", "year"], "left")
