"""Leaderboards: words, shifts between decades, superlatives, one-film words, ubiquity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialex.functions.predicates import decade
from dialex.functions.stats import shift_score


def leaderboard(words: DataFrame, stopwords: Iterable[str] = (), top: int | None = 1000, only_stopwords: bool = False) -> DataFrame:
    """(word, count, films), most said first; ties by word. With no `top`, all words in any order."""
    stop = F.col("word").isin(*stopwords)
    rows = words.where(stop if only_stopwords else ~stop)
    found = rows.groupBy("word").agg(F.sum("count").alias("count"), F.count("*").alias("films"))
    return found if top is None else found.orderBy(F.desc("count"), "word").limit(top)


def filtered_leaderboard(words: DataFrame, films: DataFrame, meta: DataFrame, where: Column, top: int = 400) -> DataFrame:
    """The leaderboard of the films that `where` keeps, with word metadata."""
    chosen = films.where(where).select("film_id")
    counts = words.join(chosen, "film_id", "left_semi").groupBy("word").agg(F.sum("count").alias("count"), F.count("*").alias("films"))
    return counts.orderBy(F.desc("count"), "word").limit(top).join(meta, "word", "left").select("word", "count", "films", "zipf", "classes", "pos", "dist")


def movieish(board: DataFrame, top: int = 50) -> DataFrame:
    """A leaderboard's rows by count weighted with distinctiveness."""
    return board.withColumn("score", F.col("count") * F.greatest(F.coalesce("dist", F.lit(0.0)), F.lit(0.0))).orderBy(F.desc("score"), "word").limit(top)


def shifts(word_year: DataFrame, min_total: int = 5000, min_decades: int = 6, quality: DataFrame | None = None) -> DataFrame:
    """(word, score, rates): how far each word's rate moved from the 1930s-40s to the 2010s-20s, on rates per million
    of a decade's words. `quality` holds the words allowed on the board."""
    rows = word_year.where("year BETWEEN 1930 AND 2029").groupBy(decade(F.col("year")).alias("decade"), "word").agg(F.sum("count").alias("c"))
    totals = rows.groupBy("decade").agg(F.sum("c").alias("t"))
    kept = rows.groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("d")).where((F.col("n") >= min_total) & (F.col("d") >= min_decades)).select("word")
    if quality is not None:
        kept = kept.join(quality.select("word"), "word", "left_semi")
    rates = rows.join(kept, "word", "left_semi").join(totals, "decade").withColumn("rate", F.col("c") / F.col("t") * 1e6)
    of = lambda d: F.sum(F.when(F.col("decade") == d, F.col("rate")).otherwise(0.0))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("decade", "rate"))), lambda s: F.struct(s["decade"], F.round(s["rate"], 1).alias("rate")))
    scored = rates.groupBy("word").agg(((of(1930) + of(1940)) / 2).alias("early"), ((of(2010) + of(2020)) / 2).alias("late"), listed.alias("rates"))
    return scored.select("word", shift_score(F.col("late"), F.col("early")).alias("score"), "rates")


def risers(scored: DataFrame, top: int = 50) -> DataFrame:
    return scored.orderBy(F.desc("score"), "word").limit(top).where("score > 0")


def fallers(scored: DataFrame, top: int = 50) -> DataFrame:
    return scored.orderBy("score", F.desc("word")).limit(top).where("score < 0")


def superlatives(films: DataFrame, words: DataFrame, profanity: Iterable[str], min_words: int = 5000, top: int = 20, min_votes: int = 1000) -> dict[str, DataFrame]:
    """Four boards of films: chattiest, vocabulary, repetitive (lowest share of distinct words), sweariest."""
    films = films.where(F.col("votes") >= min_votes)
    long = films.where(F.col("total_words") >= min_words)
    board = lambda rows, value, order: rows.select("film_id", "title", "year", value.alias("value"), order.alias("_o")).orderBy("_o", "film_id").limit(top).drop("_o")
    wpm, share = F.col("words_per_minute"), F.col("unique_words") / F.col("total_words")
    said = words.where(F.col("word").isin(*profanity)).groupBy("film_id").agg(F.sum("count").alias("n"))
    sworn = long.join(said, "film_id")
    per1k = F.round(F.col("n") / F.col("total_words") * 1000, 1)
    return {
        "chattiest": board(long.where((F.col("runtime_minutes") >= 60) & (wpm < 250)), F.round(wpm, 1), -wpm),
        "vocabulary": board(films, F.col("unique_words"), -F.col("unique_words")),
        "repetitive": board(long, F.round(share * 100, 1), share),
        "sweariest": board(sworn, per1k, -per1k),
    }


def one_film_wonders(words: DataFrame, films: DataFrame, min_top: int = 100, min_films: int = 5, dominance: float = 2.0, top: int = 50) -> DataFrame:
    """Words that one film says `dominance` times more than all others together; of equal films the smallest id."""
    t = words.groupBy("word").agg(F.sum("count").alias("total"), F.count("*").alias("films"), F.min(F.struct((-F.col("count")).alias("neg"), "film_id")).alias("b"))
    t = t.select("word", "total", "films", F.col("b.film_id").alias("film_id"), (-F.col("b.neg")).alias("count"))
    kept = t.where((F.col("count") >= min_top) & (F.col("films") >= min_films) & (F.col("count") >= (F.col("total") - F.col("count")) * dominance) & (F.length("word") >= 4) & F.col("word").rlike("[aeiouy]"))
    return kept.join(films.select("film_id", "title", "year"), "film_id").select("word", "film_id", "title", "year", "count", "total", F.round(F.col("count") / F.col("total"), 2).alias("share")).orderBy(F.desc("count"), "word").limit(top)


def ubiquity(words: DataFrame, films: DataFrame, stopwords: Iterable[str] = (), top: int = 50) -> DataFrame:
    """Words by the share of films that say them."""
    n = films.agg(F.count("*").alias("n"))
    rows = words.where(~F.col("word").isin(*stopwords)).groupBy("word").agg(F.count("*").alias("films")).orderBy(F.desc("films"), "word").limit(top)
    return rows.crossJoin(F.broadcast(n)).select("word", "films", F.round(F.col("films") / F.col("n"), 4).alias("share"))


def swears_per_film(words: DataFrame, ids: Iterable | None, profanity: Iterable[str]) -> DataFrame:
    """(film_id, swears) of the films to compare, or of all without `ids`."""
    chosen = words if ids is None else words.where(F.col("film_id").isin(*ids))
    return chosen.where(F.col("word").isin(*profanity)).groupBy("film_id").agg(F.sum("count").alias("swears"))


def page(rows: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """Page `number` of rows in an order; beyond the ends, the first or last page. Tasks keep what the pages up to this
    one hold, and no task ranks the whole list."""
    at = max(number, 1)
    if at > 1:
        at = min(at, max(1, -(-rows.count() // size)))
    return rows.orderBy(*order).offset((at - 1) * size).limit(size)
