"""Distinctive words: of films, decades and genres, by log-odds against the corpus."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialex.functions.predicates import decade
from dialex.functions.stats import log_odds_z


def log_odds(counts: DataFrame, corpus: DataFrame, key: str | tuple[str, ...] = "film_id", alpha: float = 100.0, min_count: int = 3, top: int | None = None) -> DataFrame:
    """(key, word, count, z) of counts(key, word, count) against corpus(word, count), for words said `min_count` times
    or more; totals are taken before that floor. Words that the corpus lacks have no score. A key may have several
    columns, none of them null."""
    keys = [key] if isinstance(key, str) else [*key]
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("n"))
    n_all = corpus.agg(F.sum("count").alias("n_all"))
    rows = counts.where(F.col("count") >= min_count).join(corpus.select("word", F.col("count").alias("y_all")), "word").join(totals, keys).crossJoin(F.broadcast(n_all))
    out = rows.select(*keys, "word", "count", log_odds_z(F.col("count"), F.col("n"), F.col("y_all"), F.col("n_all"), alpha).alias("z")).where("z IS NOT NULL")
    if top is None:
        return out
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("z"), "word"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top)


def memberships(films: DataFrame) -> DataFrame:
    """(kind, key, film_id): the decade and each genre of every film; a genre listed twice counts once."""
    decades = films.where("year IS NOT NULL").select(F.lit("decades").alias("kind"), decade(F.col("year")).cast("string").alias("key"), "film_id")
    genres = films.select(F.lit("genres").alias("kind"), F.explode(F.array_distinct("genres")).alias("key"), "film_id").where("key IS NOT NULL")
    return decades.unionByName(genres)


def entity_counts(words: DataFrame, films: DataFrame, only: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(kind, key, word, count, films) of all entities in one pass, and (kind, key, movie_count); of those that `only`, a
    condition on kind and key, lets through, so that words of other films aren't aggregated."""
    members = memberships(films) if only is None else memberships(films).where(only)
    sizes = members.groupBy("kind", "key").agg(F.count("*").alias("movie_count"))
    counts = words.join(members, "film_id").groupBy("kind", "key", "word").agg(F.sum("count").alias("count"), F.count("*").alias("films"))
    return counts, sizes


def _solid(counts: DataFrame, sizes: DataFrame, min_films: int) -> DataFrame:
    """counts of words that min_films films of an entity say, or all of a smaller one's, with movie_count."""
    return counts.join(sizes, ["kind", "key"]).where(F.col("films") >= F.least(F.lit(min_films), F.col("movie_count")))


def signatures_of(counts: DataFrame, sizes: DataFrame, corpus: DataFrame, stopwords: Iterable[str] = (), min_films: int = 3, min_count: int = 20, top: int = 100) -> DataFrame:
    """(kind, key, list, rank, word, count, z) of what `entity_counts` gives, against corpus(word, count): each entity's
    most said words (list top, without stopwords) and most distinctive ones (list signature), among the words of at
    least min(min_films, its films) films."""
    entity = ["kind", "key"]
    kept = _solid(counts, sizes, min_films).select(*entity, "word", "count")
    order = Window.partitionBy(*entity).orderBy(F.desc("count"), "word")
    said = kept.where(~F.col("word").isin(*stopwords)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    said = said.select(*entity, F.lit("top").alias("list"), "rank", "word", "count", F.lit(None).cast("double").alias("z"))
    odd = log_odds(kept, corpus, ("kind", "key"), min_count=min_count, top=top)
    return said.unionByName(odd.select(*entity, F.lit("signature").alias("list"), "rank", "word", "count", F.round("z", 2).alias("z")))


def signatures(words: DataFrame, films: DataFrame, stopwords: Iterable[str] = (), min_films: int = 3, min_count: int = 20, top: int = 100) -> DataFrame:
    """`signatures_of` all entities of films, against all words of these films."""
    own = words.join(films.select("film_id"), "film_id", "left_semi")
    corpus = own.groupBy("word").agg(F.sum("count").alias("count"))
    return signatures_of(*entity_counts(own, films), corpus, stopwords, min_films, min_count, top)


def figures_of(counts: DataFrame, sizes: DataFrame, profanity: Iterable[str], min_films: int = 3) -> DataFrame:
    """(kind, key, movie_count, total_words, unique_words, swears_per_1k): total_words is of the words kept by the
    floor of films, the others of all words."""
    kept = F.col("films") >= F.least(F.lit(min_films), F.col("movie_count"))
    swears = F.sum(F.when(F.col("word").isin(*profanity), F.col("count")).otherwise(0))
    return counts.join(sizes, ["kind", "key"]).groupBy("kind", "key").agg(
        F.first("movie_count").alias("movie_count"), F.coalesce(F.sum(F.when(kept, F.col("count"))), F.lit(0)).alias("total_words"), F.count("*").alias("unique_words"),
        F.round(F.coalesce(swears / F.nullif(F.sum("count"), F.lit(0)), F.lit(0.0)) * 1000, 2).alias("swears_per_1k"),
    )


def signature_figures(words: DataFrame, films: DataFrame, profanity: Iterable[str], min_films: int = 3) -> DataFrame:
    """`figures_of` all entities of films."""
    return figures_of(*entity_counts(words, films), profanity, min_films)


def top_words_of(counts: DataFrame, sizes: DataFrame, min_films: int = 3, top: int = 2000) -> DataFrame:
    """(kind, key, rank, word, count): the entities' longer word lists, stopwords included."""
    rank = F.row_number().over(Window.partitionBy("kind", "key").orderBy(F.desc("count"), "word"))
    return _solid(counts, sizes, min_films).withColumn("rank", rank).where(F.col("rank") <= top).select("kind", "key", "rank", "word", "count")


def top_words(words: DataFrame, films: DataFrame, min_films: int = 3, top: int = 2000) -> DataFrame:
    """`top_words_of` all entities of films."""
    return top_words_of(*entity_counts(words, films), min_films, top)


def head_to_head(entities: DataFrame, totals: DataFrame, min_count: int = 30, min_ratio: float = 2.5, top: int = 10) -> DataFrame:
    """(key, word, ratio): words an entity says at least `min_ratio` times as often as the entity next to it in rate.

    entities(key, word, count), totals(key, total_words). A word missing from another's list is taken at the rate of
    that list's smallest entry.
    """
    rated = entities.join(totals, "key").withColumn("rate", F.col("count") / F.greatest("total_words", F.lit(1)) * 1e6)
    lowest = totals.select("key").join(rated.groupBy("key").agg(F.min("rate").alias("floor")), "key", "left")
    # a map of the few entities that a request names, to all rows
    floors = lowest.agg(F.map_from_entries(F.collect_list(F.struct("key", F.coalesce("floor", F.lit(0.0))))).alias("_floors"))
    said = rated.groupBy("word").agg(F.collect_list(F.struct("key", "rate", "count")).alias("_said")).crossJoin(F.broadcast(floors))
    theirs = lambda k: F.get(F.filter("_said", lambda s: s["key"] == k), F.lit(0))["rate"]
    ratio = lambda x, k: x["rate"] / F.greatest(F.coalesce(theirs(k), F.element_at("_floors", k)), F.lit(0.01))
    least = lambda x: F.array_min(F.transform(F.filter(F.map_keys("_floors"), lambda k: k != x["key"]), lambda k: ratio(x, k)))
    often = F.filter("_said", lambda s: s["count"] >= min_count)
    worst = said.select("word", F.inline(F.transform(often, lambda x: F.struct(x["key"].alias("key"), least(x).alias("worst")))))
    worst = worst.where(F.col("worst") >= min_ratio).select("key", "word", F.round("worst", 1).alias("ratio"))
    return worst.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ratio"), "word"))).where(F.col("_r") <= top).drop("_r")


def shared_words(lists: DataFrame, keys: list[str], top: int = 15) -> DataFrame:
    """(rank, word) of the words on every key's list, in the order of the first key's."""
    common = lists.where(F.col("key").isin(*keys)).groupBy("word").agg(F.count_distinct("key").alias("n")).where(F.col("n") == len(keys)).select("word")
    return lists.where(F.col("key") == keys[0]).join(common, "word", "left_semi").select("rank", "word").orderBy("rank").limit(top)
