"""From texts and metadata to the corpus: counts, film figures, tiers, and the yearly tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialex.functions import text
from dialex.functions.predicates import decade, in_languages


def curated(basics: DataFrame, ratings: DataFrame, min_votes: int = 300) -> DataFrame:
    """Films of the type movie with a year and enough votes; both tables come as strings."""
    films = basics.where((F.col("titleType") == "movie") & F.col("startYear").isNotNull())
    rated = films.join(ratings, "tconst").where(F.col("numVotes").try_cast("int") >= min_votes)
    return rated.select(
        F.col("tconst").alias("film_id"), F.col("primaryTitle").alias("title"), F.col("startYear").cast("int").alias("year"), F.col("runtimeMinutes").try_cast("int").alias("runtime_minutes"),
        F.split("genres", ",").alias("genres"), F.col("averageRating").cast("double").alias("rating"), F.col("numVotes").cast("int").alias("votes"),
    )


def word_counts(docs: DataFrame, exact: bool = False) -> DataFrame:
    """(film_id, word, count) of docs(film_id, text)."""
    words = text.token_rows(docs, "film_id", "text", exact)
    return words.groupBy("film_id", "word").agg(F.count("*").alias("count"))


def film_stats(words: DataFrame, runtimes: DataFrame | None = None) -> DataFrame:
    """Total and distinct words of each film, and words a minute where a runtime is known and not zero."""
    stats = words.groupBy("film_id").agg(F.sum("count").alias("total_words"), F.count("*").cast("int").alias("unique_words"))
    if runtimes is None:
        return stats
    joined = stats.join(runtimes.select("film_id", "runtime_minutes"), "film_id", "left")
    return joined.select("film_id", "total_words", "unique_words", (F.col("total_words") / F.nullif("runtime_minutes", F.lit(0))).alias("words_per_minute"))


def all_films(curated_films: DataFrame, stats: DataFrame, languages: DataFrame, tiers: DataFrame, english_only: bool = False) -> DataFrame:
    """Curated films with figures, original language and quality tier; films without a tier are ok."""
    films = curated_films.join(stats, "film_id").join(languages, "film_id").join(tiers.select("film_id", "tier", "flags"), "film_id", "left")
    films = films.withColumns({"quality": F.coalesce("tier", F.lit("ok")), "quality_flags": F.coalesce("flags", F.array().cast("array<string>"))}).drop("tier", "flags")
    return films.where(F.col("lang") == "en") if english_only else films


def ok_films(films: DataFrame) -> DataFrame:
    return films.where(F.col("quality") == "ok").drop("quality", "quality_flags")


def flagged_films(films: DataFrame) -> DataFrame:
    return films.where(F.col("quality") != "ok")


def films_index(films: DataFrame) -> DataFrame:
    """The search index: all films, with q = low for those that aren't ok."""
    columns = ["film_id", "title", "year", "lang", "votes"]
    ok, low = ok_films(films).select(*columns, F.lit(None).cast("string").alias("q")), flagged_films(films).select(*columns, F.lit("low").alias("q"))
    return ok.unionByName(low)


def filtered_index(index: DataFrame, langs: Iterable[str] = ()) -> DataFrame:
    """The entries of the search index that belong to the corpus, those not marked low, of some languages or all."""
    return index.where(F.coalesce(F.col("q"), F.lit("")) != "low").where(in_languages(F.col("lang"), langs)).drop("q")


def words_of(words: DataFrame, films: DataFrame) -> DataFrame:
    """The words of these films only."""
    return words.join(films.select("film_id"), "film_id", "left_semi")


def without_blocked(files: DataFrame, blocked_ids: DataFrame, blocked_files: DataFrame) -> DataFrame:
    return files.join(blocked_ids, "film_id", "left_anti").join(blocked_files, ["film_id", "name"], "left_anti")


def word_year(words: DataFrame, films: DataFrame, floor: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """(word, year, *by, count, movie_count) of words said `floor` times or more (within `by`)."""
    return year_lines(words.join(films.select("film_id", "year", *by), "film_id"), floor, by)


def year_lines(rows: DataFrame, floor: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """`word_year` of words that have their years, rows(word, year, *by, count)."""
    grouped = rows.groupBy("word", "year", *by).agg(F.sum("count").alias("count"), F.count("*").alias("movie_count"))
    total = F.sum("count").over(Window.partitionBy("word", *by))
    return grouped.withColumn("_t", total).where(F.col("_t") >= floor).drop("_t")


def dictionary(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.sum("count").alias("count"))


def document_frequency(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("films"))


def year_totals(rows: DataFrame) -> DataFrame:
    """Words by year, of word_year (floored) or of words with years (not floored)."""
    return rows.groupBy("year").agg(F.sum("count").alias("total"))


def year_films(films: DataFrame) -> DataFrame:
    return films.where(F.col("year").isNotNull()).groupBy("year").agg(F.count("*").alias("films"))


def films_per_year(films: DataFrame, genre: str | None = None, in_decade: int | None = None) -> DataFrame:
    if genre is not None:
        films = films.where(F.array_contains("genres", genre))
    if in_decade is not None:
        films = films.where(decade(F.col("year")) == in_decade)
    return year_films(films)


def hero_stats(films: DataFrame) -> DataFrame:
    return films.agg(F.count("*").alias("films"), F.sum("total_words").alias("words"))


def language_manifest(films: DataFrame, at_least: int = 100) -> DataFrame:
    code = F.when(F.col("lang") == "cn", "zh").otherwise(F.col("lang"))
    return films.groupBy(code.alias("code")).agg(F.count("*").alias("films")).where(F.col("films") >= at_least).orderBy(F.desc("films"), "code")


def word_meta(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, zipf, classes, pos, dist) of (word, count) and a lexicon(word, zipf, classes, pos); unknown words are x."""
    from dialex.functions.stats import distinctiveness

    total = counts.agg(F.sum("count").alias("_n"))
    joined = counts.join(lexicon, "word", "left").crossJoin(F.broadcast(total))
    zipf = F.coalesce("zipf", F.lit(0.0))
    return joined.select("word", zipf.alias("zipf"), F.coalesce("classes", F.lit("x")).alias("classes"), F.coalesce("pos", F.lit("x")).alias("pos"), distinctiveness(F.col("count") / F.col("_n") * 1e6, zipf).alias("dist"))


def pick_certification(entries: Column) -> Column:
    """The rating code of a film from its release entries (type, date, certification): only marks that map to a code
    count; theatrical before limited before premiere before others, then the earliest date."""
    from dialex.functions.lexicon import RATING_BUCKETS, RELEASE_RANK

    buckets = F.create_map(*[F.lit(x) for kv in RATING_BUCKETS.items() for x in kv])
    ranks = F.create_map(*[F.lit(x) for kv in RELEASE_RANK.items() for x in kv])
    code = lambda e: F.try_element_at(buckets, F.upper(F.trim(F.coalesce(e["certification"], F.lit("")))))
    good = F.filter(entries, lambda e: code(e).isNotNull())
    keyed = F.transform(good, lambda e: F.struct(F.coalesce(F.try_element_at(ranks, e["type"]), F.lit(9)).alias("r"), F.coalesce(F.nullif(e["release_date"], F.lit("")), F.lit("9999")).alias("d"), code(e).alias("c")))
    return F.array_min(keyed)["c"]


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """One row: how many films each stage holds."""
    out = None
    for name, df in stages.items():
        n = df.agg(F.count("*").alias(name))
        out = n if out is None else out.crossJoin(n)
    return out
