"""One table from which the figures of any set of languages, or of any rating, are exact.

Counts and films of words are additive over films, and a film has one language and one rating. So the table holds them by
(kind, key, language, rating) for every entity (all films, a decade, a genre, a year), with and without the word, and a
slice is a sum over some of its rows: no scan of the words, and none of the errors that merging cut lists has.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialex.functions.predicates import decade, in_languages
from dialex.operators import signatures
from dialex.operators.slices import RATED_SINCE

#: The entity that all films belong to.
ALL = "all"


def members(films: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    """(film_id, lang, rating, entities): of every film its language, its rating where it has one and is of a year with
    ratings, and an array of the (kind, key) it belongs to. nc17 counts as r; a genre listed twice counts once."""
    rating = F.lit(None).cast("string")
    rated = films
    if ratings is not None:
        rated = films.join(ratings.select("film_id", F.col("rating").alias("_rating")), "film_id", "left")
        rating = F.when(F.col("year") >= RATED_SINCE, F.when(F.col("_rating") == "nc17", "r").otherwise(F.col("_rating")))
    entity = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    genres = F.transform(F.coalesce(F.array_distinct("genres"), F.array().cast("array<string>")), lambda g: entity("genres", g))
    own = F.concat(F.array(entity("decades", decade(F.col("year"))), entity("years", F.col("year")), entity(ALL, F.lit(""))), genres)
    return rated.select("film_id", "lang", rating.alias("rating"), F.filter(own, lambda e: e["key"].isNotNull()).alias("entities"))


def cube(words: DataFrame, films: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    """(kind, key, lang, rating, word, count, films), for every word and, where word is null, for the entity as a whole:
    all words of its films, and how many films it has, those that say nothing included.

    Words are dealt by word before they are repeated for their film's entities, and summed where they lie: what is
    shuffled is a row a film and word, whatever the number of entities, and no word has more rows than there are films.
    The number of partitions is stated, as rows become several times as many after it."""
    entity = ["kind", "key", "lang", "rating"]
    belongs = members(films, ratings)
    totals = words.groupBy("film_id").agg(F.sum("count").alias("count"))
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = words.join(belongs, "film_id").select("word", "count", "lang", "rating", "entities").repartition(n, "word")
    whole = belongs.join(totals, "film_id", "left").select(F.lit(None).cast("string").alias("word"), F.coalesce("count", F.lit(0)).alias("count"), "lang", "rating", "entities")
    summed = lambda rows: rows.select("lang", "rating", "word", "count", F.inline("entities")).groupBy(*entity, "word").agg(F.sum("count").alias("count"), F.count("*").alias("films"))
    return summed(said).unionByName(summed(whole))


def write(table: DataFrame, path: str) -> None:
    """The cube in files sorted by entity and word, so that a request for a kind or an entity reads a part of each. It
    is not dealt anew: the rows of a word lie in one file."""
    from dialex.sources.writers import sorted_files

    sorted_files(table, path, "kind", "key", "word")


def scope(langs: Iterable[str] = (), rating: str | None = None) -> Column:
    """The rows of a slice: of a rating, else of some languages, else all."""
    return F.col("rating") == rating if rating else in_languages(F.col("lang"), list(langs))


def entities(table: DataFrame, langs: Iterable[str] = (), rating: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a slice: (kind, key, word, count, films), (kind, key, movie_count) and the corpus (word, count), as the
    signature operators take them."""
    rows = table.where(scope(langs, rating))
    own = rows.where(F.col("kind").isin("decades", "genres"))
    counts = own.where("word IS NOT NULL").groupBy("kind", "key", "word").agg(F.sum("count").alias("count"), F.sum("films").alias("films"))
    sizes = own.where("word IS NULL").groupBy("kind", "key").agg(F.sum("films").alias("movie_count"))
    corpus = rows.where((F.col("kind") == ALL) & F.col("word").isNotNull()).groupBy("word").agg(F.sum("count").alias("count"))
    return counts, sizes, corpus


def signature(table: DataFrame, langs: Iterable[str] = (), rating: str | None = None, stopwords: Iterable[str] = (), **floors) -> DataFrame:
    """The signatures of decades and genres within a slice, exactly as if they were counted from its films."""
    counts, sizes, corpus = entities(table, langs, rating)
    return signatures.signatures_of(counts, sizes, corpus, stopwords, **floors)


def word_year(table: DataFrame, langs: Iterable[str] = (), rating: str | None = None, floor: int = 20) -> DataFrame:
    """(word, year, count, movie_count) of a slice, for words said `floor` times or more within it."""
    rows = table.where(scope(langs, rating) & F.col("word").isNotNull())
    solid = rows.where(F.col("kind") == "years").groupBy("word").agg(F.sum("count").alias("_t")).where(F.col("_t") >= floor).select("word")
    lines = rows.where(F.col("kind") == "years").groupBy("word", F.col("key").cast("int").alias("year")).agg(F.sum("count").alias("count"), F.sum("films").alias("movie_count"))
    return lines.join(solid, "word", "left_semi")


def year_totals(table: DataFrame, langs: Iterable[str] = (), rating: str | None = None) -> DataFrame:
    """(year, total, films) of a slice: what yearly rates and averages a film are divided by."""
    rows = table.where(scope(langs, rating) & (F.col("kind") == "years") & F.col("word").isNull())
    return rows.groupBy(F.col("key").cast("int").alias("year")).agg(F.sum("count").alias("total"), F.sum("films").alias("films"))


def leaderboard(table: DataFrame, langs: Iterable[str] = (), rating: str | None = None, kind: str = ALL, key: str = "") -> DataFrame:
    """(word, count, films) of an entity within a slice."""
    rows = table.where(scope(langs, rating) & (F.col("kind") == kind) & (F.col("key") == key) & F.col("word").isNotNull())
    return rows.groupBy("word").agg(F.sum("count").alias("count"), F.sum("films").alias("films"))
