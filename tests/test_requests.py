"""The cube, the SQL surface and the search index."""

import pytest
from pyspark.sql import functions as F

from dialex import surface
from dialex.operators import cube, pages, signatures
from dialex.operators.corpus import words_of
from dialex.operators.search import TrigramIndex
from dialex.plans.corpus import Corpus


@pytest.fixture(scope="module")
def c(spark, sf_dir):
    return Corpus.of(spark, sf_dir)


@pytest.fixture(scope="module")
def table(spark, c, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cube"))
    cube.write(cube.cube(c.words, c.films, c.ratings), path)
    return spark.read.parquet(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("langs", [[], ["en"], ["en", "fr"], ["zh", "de"], ["xx"]])
def test_signatures_of_any_set_of_languages_equal_those_of_its_films(c, table, langs):
    films = c.films.where(cube.in_languages(F.col("lang"), langs))
    want = signatures.signatures(words_of(c.words, films), films, c.stopwords, min_count=5, top=20)
    got = cube.signature(table, langs, stopwords=c.stopwords, min_count=5, top=20)
    assert rows(got) == rows(want)


def test_a_film_without_words_counts_as_a_film(spark):
    films = spark.createDataFrame([(1, 1999, ["Drama"], "en"), (2, 1999, ["Drama"], "cn"), (3, None, [], None)], "film_id long, year int, genres array<string>, lang string")
    words = spark.createDataFrame([(1, "a", 3), (3, "a", 1)], "film_id long, word string, count long")
    table = cube.cube(words, films)
    assert rows(cube.year_totals(table)) == [(1999, 3, 2)] and rows(cube.year_totals(table, ["zh"])) == [(1999, 0, 1)]
    assert rows(cube.leaderboard(table)) == [("a", 4, 2)] and rows(cube.word_year(table, floor=3)) == [("a", 1999, 3, 1)]
    rated = cube.cube(words, films, spark.createDataFrame([(1, "nc17")], "film_id long, rating string"))
    assert rows(cube.leaderboard(rated, rating="r")) == [("a", 3, 1)] and rows(cube.leaderboard(rated, rating="pg")) == []


def test_a_slice_reads_no_words(table):
    plan = cube.signature(table, ["en"])._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and plan.count("FileScan parquet") >= 2 and "In(kind, [decades,genres])" in plan and "EqualTo(lang,en)" in plan


@pytest.fixture(scope="module")
def index(spark, c, tmp_path_factory):
    path = tmp_path_factory.mktemp("index")
    c.dictionary.select(F.monotonically_increasing_id().alias("id"), F.col("word").alias("text")).write.parquet(str(path / "words"))
    out = TrigramIndex(spark, str(path / "index"))
    out.build(spark.read.parquet(str(path / "words")))
    return out


def test_the_index_finds_what_a_scan_finds(spark, c, index):
    words = sorted(r.word for r in c.dictionary.collect())
    patterns = sorted({w[i : i + n] for w in words[::40] for n in (3, 4, 6) for i in (0, 1) if len(w) >= n + i})[:100] + ["qqq", "'", "th", "THER", " ther "]
    asked = spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string")
    got = sorted((r.pattern, r.text) for r in index.find_all(asked).collect())
    assert got == sorted((p, w) for p in patterns for w in words if p.strip().lower() in w)
    for p in ("the", "th", "", "qqq"):
        assert sorted(r.text for r in index.find(p).collect()) == [w for w in words if p in w]


def test_a_search_reads_its_grams_only(c, index):
    found = index.candidates("there")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [ere,her,the])" in plan.replace("\n", "")
    postings = index.postings(["qzx"])
    postings.collect()
    leaf = postings._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    total = index.spark.read.parquet(f"{index.path}/postings").count()
    assert leaf.metrics().apply("numOutputRows").value() < 0.1 * total


def test_stretched_words_and_odd_texts(spark, tmp_path):
    texts = [(1, "Sooo good"), (2, "so"), (3, "sooo"), (4, None), (5, ""), (6, "SoOo"), (7, "İstanbul"), (None, "lost")]
    index = TrigramIndex(spark, str(tmp_path))
    index.build(spark.createDataFrame(texts, "id long, text string"))
    assert sorted(r.id for r in index.find("so", stretched=True).collect()) == [1, 2, 3, 6]
    assert sorted(r.id for r in index.find("sooo", stretched=True).collect()) == [1, 3, 6]
    assert sorted(r.id for r in index.find("so", stretched=False).collect()) == [1, 2, 3, 6]
    assert [r.id for r in index.find("good").collect()] == [1] and index.find("").count() == 6
    plain = spark.createDataFrame([(w,) for _, w in texts if w], "word string")
    assert sorted(r.word for r in pages.find_words(plain.where("word <> 'İstanbul'"), "so").collect()) == ["so", "sooo"]


def test_functions_push_their_arguments_into_the_scans(spark, c, tmp_path):
    surface.write(c.films, c.words, c.meta, str(tmp_path))
    surface.publish(spark, str(tmp_path))
    plan = spark.sql("SELECT * FROM saying('hand')")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(word,hand)" in plan
    plan = spark.sql("SELECT * FROM film(9)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(film_id,9)" in plan
    assert spark.sql("SELECT count(*) AS n FROM leaderboard()").first().n == c.dictionary.count()
    assert spark.sql("SELECT count(*) AS n FROM film(-1)").first().n == 0 and spark.sql("SELECT sum(count) AS n FROM trend('nothing')").first().n == 0


def test_many_patterns_meet_texts_by_their_rarest_trigram(spark, tmp_path):
    """Texts aren't counted for each pattern and text; a pattern with a trigram that no text has is in none."""
    import re

    index = TrigramIndex(spark, str(tmp_path / "rarest"))
    index.build(spark.createDataFrame([(i, f"common{i:03d}") for i in range(50)] + [(50, "commoner")], "id long, text string"))
    found = index.find_all(spark.createDataFrame([("moner",), ("mon04",), ("monzz",), ("erc",)], "pattern string"))
    assert not re.search(r"hashpartitioning\(q#\d+, id#", found._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.pattern, r.id) for r in found.collect()) == [("mon04", i) for i in range(40, 50)] + [("moner", 50)]
