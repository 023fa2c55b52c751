"""Language and rating slices, and merges of what slices hold.

`merge_*` functions put together lists that were cut to their tops, as a client that only has those would; exact
figures over several slices come from running the operators on the films of all of them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialex.functions.predicates import in_languages
from dialex.operators import trends
from dialex.operators.corpus import word_year, words_of

RATED_SINCE = 1968


def language_slice(films: DataFrame, words: DataFrame, word_year_lang: DataFrame, code: str, floor: int = 20) -> dict[str, DataFrame]:
    """Films, words and yearly counts of one language. The yearly counts sum the tables already floored per code, and
    are floored again."""
    chosen = films.where(in_languages(F.col("lang"), [code]))
    rows = word_year_lang.where(in_languages(F.col("lang"), [code])).groupBy("word", "year").agg(F.sum("count").alias("count"), F.sum("movie_count").alias("movie_count"))
    rows = rows.withColumn("_t", F.sum("count").over(Window.partitionBy("word"))).where(F.col("_t") >= floor).drop("_t")
    return {"films": chosen, "words": words_of(words, chosen), "word_year": rows}


def rating_slice(films: DataFrame, words: DataFrame, ratings: DataFrame, code: str, floor: int = 20) -> dict[str, DataFrame]:
    """Films of a rating since ratings exist, their words and yearly counts; r takes in nc17."""
    members = ["r", "nc17"] if code == "r" else [code]
    chosen = films.join(ratings.where(F.col("rating").isin(*members)).select("film_id"), "film_id", "left_semi").where(F.col("year") >= RATED_SINCE)
    own = words_of(words, chosen)
    return {"films": chosen, "words": own, "word_year": word_year(own, chosen, floor)}


def all_slices(films: DataFrame, ratings: DataFrame) -> DataFrame:
    """(slice, film_id): the global slice, each language's and each rating's, so that one run bakes them all."""
    lang = F.when(F.col("lang") == "cn", "zh").otherwise(F.col("lang"))
    rated = films.where(F.col("year") >= RATED_SINCE).join(ratings, "film_id").select(F.concat(F.lit("rating:"), F.when(F.col("rating") == "nc17", "r").otherwise(F.col("rating"))).alias("slice"), "film_id")
    return films.select(F.lit("global").alias("slice"), "film_id").unionByName(films.select(F.concat(F.lit("lang:"), lang).alias("slice"), "film_id")).unionByName(rated)


def sliced_word_year(words: DataFrame, films: DataFrame, slices: DataFrame, floor: int = 20) -> DataFrame:
    return word_year(words, slices.join(films.select("film_id", "year"), "film_id"), floor, by=("slice",))


def union(parts: Iterable[DataFrame]) -> DataFrame:
    """The parts one below the other, with their place in the order as _part."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def merge_words(parts: list[DataFrame], top: int = 1000) -> DataFrame:
    """Counts and films summed by word; other columns from the first part that has the word."""
    rows = union(parts)
    rest = [c for c in rows.columns if c not in ("word", "count", "films", "_part")]
    kept = [F.min_by(F.struct(*rest), "_part").alias("_m")] if rest else []
    out = rows.groupBy("word").agg(F.sum("count").alias("count"), F.sum("films").alias("films"), *kept).orderBy(F.desc("count"), "word").limit(top)
    return out.select("word", "count", "films", *[F.col(f"_m.{c}").alias(c) for c in rest])


def merge_by_year(parts: list[DataFrame], value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Yearly figures summed: totals, or lines with keys=('word',)."""
    return union(parts).groupBy(*keys, "year").agg(F.sum(value).alias(value))


def merge_top_films(parts: list[DataFrame], top: int = 15) -> DataFrame:
    return union(parts).orderBy(F.desc("count"), "_part", "film_id").limit(top).drop("_part")


def merge_trend_files(parts: list[DataFrame], top: int = 15) -> DataFrame:
    """Trend files (word, line, top, by_year) of several languages as one: lines summed, films ranked anew by count (of
    equal ones the first part's, then by rank), and for each year the film with the largest count, the first part's in a
    tie. A word that one part lacks has what the others say."""
    rows = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    said = merge_by_year([trends.file_lines(p) for p in parts], "count", ("word",))
    line = said.groupBy("word").agg(rows("year", "count").alias("line"))
    order = Window.partitionBy("word").orderBy(F.desc("count"), "_part", "rank")
    best = union(trends.file_top_films(p) for p in parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    films = best.groupBy("word").agg(rows("rank", "film_id", "title", "year", "count", "total_words").alias("top"))
    first = F.row_number().over(Window.partitionBy("word", "year").orderBy(F.desc("count"), "_part"))
    yearly = union(trends.file_by_year(p) for p in parts).withColumn("_r", first).where("_r = 1")
    years = yearly.groupBy("word").agg(rows("year", "film_id", "title", "count").alias("by_year"))
    return line.join(films, "word", "left").join(years, "word", "left")


def merge_featured(parts: list[DataFrame]) -> DataFrame:
    """Featured files (word, year, count), where the word of the yearly totals is empty, summed over their languages."""
    return merge_by_year(parts, "count", ("word",))


def merge_superlatives(parts: list[DataFrame], ascending: bool = False, top: int = 20) -> DataFrame:
    """Boards of films put together. A board of smallest values is merged ascending; clients that merge every board
    descending get that with ascending=False."""
    return union(parts).orderBy(F.asc("value") if ascending else F.desc("value"), "_part", "film_id").limit(top).drop("_part")


def merge_wonders(parts: list[DataFrame], top: int = 50) -> DataFrame:
    """One-film words that are on one part's list only."""
    rows = union(parts)
    once = rows.groupBy("word").agg(F.count("*").alias("n")).where("n = 1").select("word")
    return rows.join(once, "word", "left_semi").orderBy(F.desc("share"), "_part", "word").limit(top).drop("_part")


def merge_ubiquity(parts: list[DataFrame], top: int = 200) -> DataFrame:
    """Shares over the films of all parts that list a word; a part's films are recovered from its share."""
    rows = union(parts).withColumn("_n", F.when(F.col("share") > 0, F.round(F.col("films") / F.col("share"))).otherwise(0))
    merged = rows.groupBy("word").agg(F.sum("films").alias("films"), F.sum("_n").alias("_n"))
    return merged.select("word", "films", F.when(F.col("_n") > 0, F.col("films") / F.col("_n")).otherwise(0.0).alias("share")).orderBy(F.desc("films"), "word").limit(top)


def merge_shifts(parts: list[DataFrame], top: int = 30) -> DataFrame:
    """For each word the entry with the largest shift; of equal ones the first part's."""
    rows = union(parts)
    best = rows.groupBy("word").agg(F.min(F.struct((-F.abs("score")).alias("s"), "_part", F.col("score").alias("score"))).alias("b"))
    return best.select("word", F.col("b.score").alias("score")).orderBy(F.desc(F.abs("score")), "word").limit(top)


def merge_signatures(parts: list[DataFrame], min_count: int = 20, top: int = 100) -> DataFrame:
    """(key, word, count, z) over the parts' top lists (key, word, count): counts summed, and log-odds against the sum
    of all lists."""
    from dialex.operators.signatures import log_odds

    rows = union(parts)
    summed = rows.groupBy("key", "word").agg(F.sum("count").alias("count"))
    corpus = rows.groupBy("word").agg(F.sum("count").alias("count"))
    return log_odds(summed, corpus, "key", min_count=min_count, top=top).withColumn("z", F.round("z", 2))


def merge_word_lists(top: DataFrame, all_words: DataFrame) -> DataFrame:
    """Two lists of a film's words as one: a word stands where it first comes, with what was said of it last."""
    rows = union([top, all_words])
    return rows.groupBy("word").agg(F.min(F.struct("_part", "rank")).alias("_at"), F.max_by("count", "_part").alias("count")).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_at"))).select("rank", "word", "count")
