"""Trend files merged and taken apart, film contexts, figures to read, and token rows."""

from pyspark.sql import functions as F

from dialex import api
from dialex.functions import stats, text
from dialex.operators import selection, slices


def test_featured_rotation():
    assert api.day_index(5, 86_400 * 7 + 5) == 2
    assert [api.step_featured(i, d, 3) for i, d in ((2, 1), (0, -1), (1, 1))] == [0, 2, 2]
    assert api.toggle_pin(["a"], "b") == ["a", "b"] and api.toggle_pin(["a", "b"], "a") == ["b"]


def test_figures_to_read(spark):
    df = spark.createDataFrame([(0, 10, 0.0, 0.0), (1, 100_000, 0.001, -3.0), (3, 1000, 0.256, 1.0), (25, 10_000, 12.34, 2.0), (1, 0, 1.0, 0.5)], "c long, t long, v double, s double")
    got = df.select(stats.per_1k_label(F.col("c"), F.col("t")), stats.per_film_label(F.col("v")), stats.shift_ratio(F.col("s"))).collect()
    assert [tuple(r)[:2] for r in got] == [("0", "0"), ("<0.1", "<0.01"), ("3", "0.26"), ("2.5", "12.3"), ("1,000", "1.0")]
    assert [r[2] for r in got][:4] == [1.0, 8.0, 2.0, 4.0]


def test_merge_trend_files(spark):
    schema = "word string, line array<struct<year:int,count:long>>, top array<struct<rank:int,film_id:string,title:string,year:int,count:long,total_words:long>>, by_year array<struct<year:int,film_id:string,title:string,count:long>>"
    a = spark.createDataFrame([("w", [(1990, 3), (1991, 1)], [(1, "a", "A", 1990, 3, 10), (2, "b", "B", 1991, 1, 10)], [(1990, "a", "A", 3), (1991, "b", "B", 1)])], schema)
    b = spark.createDataFrame([("w", [(1991, 4)], [(1, "c", "C", 1991, 3, 9)], [(1991, "c", "C", 3)]), ("v", [(1990, 2)], None, [(1990, "d", "D", 2)])], schema)
    got = {r.word: r for r in slices.merge_trend_files([a, b], top=2).collect()}
    assert [tuple(x) for x in got["w"].line] == [(1990, 3), (1991, 5)]
    assert [(x.rank, x.film_id) for x in got["w"].top] == [(1, "a"), (2, "c")]  # equal counts: the first part's film first
    assert [x.film_id for x in got["w"].by_year] == ["a", "c"] and got["v"].top is None


def test_film_context(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "film_id string")
    curated = spark.createDataFrame([("a", 1950, ["Documentary"]), ("z", 1, [])], "film_id string, year int, genres array<string>")
    languages = spark.createDataFrame([("b", None)], "film_id string, lang string")
    credits = spark.createDataFrame([("a", "Self", "Ann Lee"), ("a", "Bob (voice)", "X"), ("b", None, None)], "film_id string, character string, actor string")
    verified = spark.createDataFrame([("a",), ("a",)], "film_id string")
    got = selection.film_context(ids, curated, languages, credits, verified, ("lee",))
    assert {r.film_id: (r.year, r.documentary, r.verified, r.english, r.cast) for r in got.collect()} == {"a": (1950, True, True, None, ["ann", "bob"]), "b": (None, None, None, False, [])}


def test_token_rows_are_the_tokens(spark):
    texts = ["It's 'quoted' text, don't ''double'' it", "’tis a ‘test’ i x 'a' ' ''", "Ça été naïve ét'e", "plain words only", "", None, "rock 'n' roll'", "a1b c_d ﬁn"]
    df = spark.createDataFrame(list(enumerate(texts)), "film_id int, text string")
    flat = df.select("film_id", F.explode(text.tokens(F.col("text"))).alias("word"))
    assert sorted(map(tuple, text.token_rows(df, "film_id", "text").collect())) == sorted(map(tuple, flat.collect()))
