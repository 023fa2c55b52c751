"""What a page shows: a film's words, an entity's films, search, and the word explorer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialex.functions import text
from dialex.functions.predicates import decade
from dialex.functions.stats import log_odds_z
from dialex.operators.corpus import document_frequency

NO_META = {"zipf": 0.0, "classes": "x", "pos": "x", "dist": 0.0}


def tagged(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """rows with word metadata; unknown words have the neutral values."""
    return rows.join(meta.select("word", *NO_META), "word", "left").fillna(NO_META)


def film_lists(words: DataFrame, corpus: DataFrame, stopwords: Iterable[str], top: int = 200, top_all: int = 50, distinctive: int = 50, min_count: int = 3) -> DataFrame:
    """(film_id, list, rank, word, count, z): the lists of a film's page. All films are done in one pass, dealt out by
    film once: the words most said without stopwords (top) and with them (top_all), and the most distinctive of those
    said `min_count` times or more. Only these meet the corpus; rarer ones have no score and aren't shuffled by word."""
    film = Window.partitionBy("film_id")
    n_all = F.broadcast(corpus.agg(F.sum("count").alias("_n_all")))
    met = words.where(F.col("count") >= min_count).join(corpus.select("word", F.col("count").alias("_y_all")), "word", "left")
    rare = words.where(~F.coalesce(F.col("count") >= min_count, F.lit(False))).withColumn("_y_all", F.lit(None).cast("long"))
    said = met.select("film_id", "word", "count", "_y_all").unionByName(rare.select("film_id", "word", "count", "_y_all")).crossJoin(n_all)
    said = said.withColumns({"_stop": F.col("word").isin(*stopwords), "_n": F.sum("count").over(film)})
    z = F.when(F.col("count") >= min_count, log_odds_z(F.col("count"), F.col("_n"), F.col("_y_all"), F.col("_n_all")))
    said = said.withColumn("_z", z)
    place = lambda *order: F.row_number().over(film.orderBy(*order))
    ranked = said.withColumns({"_all": place(F.desc("count"), "word"), "_top": place("_stop", F.desc("count"), "word"), "_odd": place(F.desc_nulls_last("_z"), "word")})
    entry = lambda name, rank, keep, score: F.when(keep, F.struct(F.lit(name).alias("list"), F.col(rank).alias("rank"), score.alias("z")))
    none = F.lit(None).cast("double")
    lists = F.array(
        entry("top", "_top", ~F.col("_stop") & (F.col("_top") <= top), none), entry("top_all", "_all", F.col("_all") <= top_all, none),
        entry("distinctive", "_odd", F.col("_z").isNotNull() & (F.col("_odd") <= distinctive), F.round("_z", 2)),
    )
    rows = ranked.select("film_id", "word", "count", F.inline(F.filter(lists, lambda x: x.isNotNull())))
    return rows.select("film_id", "list", "rank", "word", "count", "z")


def film_page(words: DataFrame, corpus: DataFrame, meta: DataFrame, stopwords: Iterable[str], **sizes) -> DataFrame:
    """(film_id, list, rank, word, count, z, zipf, classes, pos): `film_lists` with word metadata."""
    return tagged(film_lists(words, corpus, stopwords, **sizes), meta).select("film_id", "list", "rank", "word", "count", "z", "zipf", "classes", "pos")


def payloads(lists: DataFrame, films: DataFrame) -> DataFrame:
    """(key, payload): a JSON document a film, for export."""
    entry = F.struct("rank", "word", "count", "z")
    of = lambda name: F.array_sort(F.collect_list(F.when(F.col("list") == name, entry))).alias(name)
    grouped = lists.groupBy("film_id").agg(of("top"), of("top_all"), of("distinctive"))
    return films.join(grouped, "film_id").select(F.col("film_id").cast("string").alias("key"), F.to_json(F.struct(*[c for c in films.columns], "top", "top_all", "distinctive")).alias("payload"))


def film_words(words: DataFrame, flagged: DataFrame) -> DataFrame:
    """(film_id, word, count, films): every film's words with the films that say each; a flagged film, which the corpus
    doesn't count, counts itself."""
    df = document_frequency(words)
    own = words.select("film_id", "word", "count", F.lit(0).alias("_self")).unionByName(flagged.select("film_id", "word", "count", F.lit(1).alias("_self")))
    return own.join(df, "word", "left").select("film_id", "word", "count", (F.coalesce("films", F.lit(0)) + F.col("_self")).alias("films"))


def title_search(films: DataFrame, query: str, top: int = 8) -> DataFrame:
    return films.where(F.lower("title").contains(query.strip().lower())).orderBy(F.desc("votes"), "film_id").limit(top)


def entity_films(films: DataFrame, key: str, top: int = 12) -> DataFrame:
    """The films of an entity, d:1980 for a decade and g:Crime for a genre, most votes first."""
    kind, _, value = key.partition(":")
    match = decade(F.col("year")) == int(value) if kind == "d" else F.array_contains("genres", value)
    return films.where(match).orderBy(F.desc("votes"), "film_id").limit(top)


def entity_index(figures: DataFrame) -> DataFrame:
    """(kind, key, movie_count, place): decades by year, genres by their number of films."""
    order = Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "decades", F.col("key")), F.desc("movie_count"), "key")
    return figures.where("movie_count > 0").select("kind", "key", "movie_count", F.row_number().over(order).alias("place"))


def random_shelf(films: DataFrame, seed: int, pool: int = 60, size: int = 8) -> DataFrame:
    """A few of the films with most votes, in an order that the seed gives."""
    return films.orderBy(F.desc("votes"), "film_id").limit(pool).orderBy(F.md5(F.concat_ws("-", F.lit(seed), "film_id")), "film_id").limit(size)


def sort_words(rows: DataFrame, by: str) -> list[Column]:
    """Orders of the word explorer: count, az, or rare (fewest films first); ties by word."""
    return {"count": [F.desc("count"), F.asc("word")], "az": [F.asc("word")], "rare": [F.asc("films"), F.desc("count"), F.asc("word")]}[by]


def only_in_film(rows: DataFrame, top: int = 10) -> DataFrame:
    """Words of letters only that no other film says, said twice or more."""
    return rows.where((F.col("films") == 1) & (F.col("count") >= 2) & F.col("word").rlike(r"^\p{L}+$")).orderBy(F.desc("count"), "word").limit(top)


def find_words(rows: DataFrame, query: str) -> DataFrame:
    """Words that hold the query, and stretched spellings of it (sooo for so)."""
    q = query.strip().lower()
    same = (text.collapse(F.col("word")) == text.collapse(F.lit(q))) & text.is_stretched(F.col("word"))
    return rows.where(F.col("word").contains(q) | same)


def stretched(rows: DataFrame) -> DataFrame:
    """(word, base): words with a letter thrice in a row, and what they collapse to."""
    return rows.where(text.is_stretched(F.col("word"))).select("word", text.collapse(F.col("word")).alias("base"))
