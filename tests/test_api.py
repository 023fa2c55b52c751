"""Requests: addresses of charts, comparisons that count only what is compared, and small shapings of results."""

from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from dialex import api
from dialex.operators import corpus, selection, signatures, trends
from dialex.plans.corpus import Corpus


@pytest.fixture(scope="module")
def c(spark, sf_dir):
    return Corpus.of(spark, sf_dir)


@pytest.fixture(scope="module")
def engine(c):
    return api.Engine(c.films, c.words, c.meta, c.ratings)


def test_links_are_taken_apart_as_they_were_put_together():
    link = api.trends_link(["phone", "l'amour", "rock & roll"], per_film=True, rating="pg13")
    assert link == "/trends?w=phone%2Cl'amour%2Crock%20%26%20roll&per=film&rating=pg13"
    params = {k: v[0] for k, v in parse_qs(urlsplit(link).query).items()}
    assert api.asked_words(params["w"]) == ["phone", "l'amour", "rock & roll"] and api.is_per_film(params) and api.asked_rating(params["rating"]) == "pg13"
    assert api.trends_link(["war"]) == "/trends?w=war" and not api.is_per_film({}) and not api.is_per_film({"per": "year"})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_compare_equals_a_comparison_of_all_entities(c, engine):
    film = str(c.films.orderBy(F.desc("total_words")).first().film_id)
    for keys in ([film, "d:2010", "g:src4", "d:1990"], ["d:1700", film]):
        top, figures = signatures.top_words(c.words, c.films), signatures.signature_figures(c.words, c.films, c.profanity)
        name = F.concat(F.substring("kind", 1, 1), F.lit(":"), "key")
        asked = keys[:3]
        lists = top.where(name.isin(asked)).select(name.alias("key"), "word", "count").unionByName(c.words.where(F.col("film_id").cast("string").isin(asked)).select(F.col("film_id").cast("string").alias("key"), "word", "count"))
        totals = figures.where(name.isin(asked)).select(name.alias("key"), "total_words").unionByName(c.films.where(F.col("film_id").cast("string").isin(asked)).select(F.col("film_id").cast("string").alias("key"), "total_words"))
        want = signatures.head_to_head(lists, totals, 3, 1.5)
        assert rows(engine.compare(keys, 3, 1.5)) == rows(want)


def test_only_the_films_of_what_is_compared_are_counted(engine):
    plan = engine.compare(["d:1980", "d:1990"])._jdf.queryExecution().optimizedPlan().toString()
    assert "1980" in plan and "1990" in plan
    assert engine.film(9).where("list = 'top'").count() > 0 and engine.dictionary.is_cached


def test_films_since_and_top_film_rows(spark):
    by_year = spark.createDataFrame([(1960, 2), (1968, 3), (1999, 4)], "year int, films long")
    assert [trends.films_since(by_year, y).first().films for y in (1900, 1968, 2100)] == [9, 7, 0]
    best = spark.createDataFrame([("a", 1968, "f1", "F", 5)], "word string, year int, film_id string, title string, count long")
    got = trends.top_film_rows(by_year.select("year"), best, ["a", "b", "a"])
    assert rows(got) == rows(spark.createDataFrame([(w, y, *(("f1", "F", 5) if (w, y) == ("a", 1968) else (None, None, None))) for w in "ab" for y in (1960, 1968, 1999)], got.schema))


def test_the_index_is_cut_down_to_the_corpus(spark):
    index = spark.createDataFrame([("a", "en", None), ("b", "fr", None), ("c", "cn", None), ("d", "en", "low")], "film_id string, lang string, q string")
    assert [sorted(r.film_id for r in corpus.filtered_index(index, langs).collect()) for langs in ([], ["en"], ["zh"], ["en", "zh"])] == [["a", "b", "c"], ["a"], ["c"], ["a", "c"]]


def test_full_counts_with_another_pattern(spark):
    chosen = spark.createDataFrame([("a", "ok", []), ("b", "ok", []), ("c", "ok", ["anachronism"])], "film_id string, tier string, flags array<string>")
    words = spark.createDataFrame([("a", "darned", 1), ("b", "darned", 1), ("c", "darn", 9)], "film_id string, word string, count long")
    films = spark.createDataFrame([("a", True, False, None, 1950), ("b", True, False, True, 1950), ("c", True, False, None, 1950)], "film_id string, english boolean, documentary boolean, verified boolean, year int")
    got = {r.film_id: (r.tier, r.flags) for r in selection.check_full_counts(chosen, words, films, "^darn").collect()}
    assert got == {"a": ("low", ["anachronism"]), "b": ("ok", []), "c": ("ok", ["anachronism"])}
