"""What is shuffled: texts once by film, and no counts again where films are joined or words ranked."""

import json
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from dialex.functions import text
from dialex.operators import audit, cube, trends
from dialex.plans import corpus as plans
from dialex.plans import audits, entities, series
from dialex.plans.corpus import Corpus
from dialex.sources import writers
from dialex.streaming import aggregates


@pytest.fixture
def shuffled_joins(spark):
    """Joins as on tables too large to be broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n in names:
        spark.conf.unset(n)


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString()))


def corpus(spark, sf_dir, tmp_path) -> Corpus:
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    return Corpus(spark, str(tmp_path))


def test_texts_are_dealt_by_film_and_counts_are_not(spark, sf_dir, tmp_path, shuffled_joins):
    c = corpus(spark, sf_dir, tmp_path)
    assert {keys.split(",")[0] for keys in exchanges(c.counts)} == {"film_id"}
    assert not any("word" in keys for keys in exchanges(c.counts))
    words = c.words
    assert words.collect()
    outside = words._jdf.queryExecution().executedPlan().toString()  # the final one, which knows how the counts lie
    assert "Join" in outside and "Exchange" not in outside.split("InMemoryRelation")[0]
    c.all_films.unpersist()
    c.counts.unpersist()


def test_trend_files_rank_words_before_they_are_shuffled(spark):
    films = spark.createDataFrame([(1, "A", 1990, 30), (2, "B", 1990, 30)], "film_id long, title string, year int, total_words long")
    words = spark.createDataFrame([(1, "w", 25), (2, "w", 25), (2, "rare", 5)], "film_id long, word string, count long")
    lines = spark.createDataFrame([("w", 1990, 50)], "word string, year int, count long")
    files = trends.trend_files(lines, words, films)
    assert "LeftSemi" not in files._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.word, [x.film_id for x in r.top], [x.film_id for x in r.by_year]) for r in files.collect()] == [("w", [1, 2], [1])]


def test_texts_are_split_once(spark):
    df = spark.createDataFrame([(1, "ab c'd"), (2, "çé x9 i")], "film_id int, text string")
    rows = text.token_rows(df, "film_id", "text")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted(map(tuple, rows.groupBy("film_id").agg(F.sort_array(F.collect_list("word"))).collect())) == [(1, ["ab", "c'd"]), (2, ["ce", "i"])]


@pytest.mark.parametrize("query", [series.trend_by_year, series.trend_top15])
def test_lists_are_ranked_before_they_meet_the_charted_words(spark, query):
    films = spark.createDataFrame([(1, "A", 1990, 30), (2, "B", 1990, 30)], "film_id long, title string, year int, total_words long")
    words = spark.createDataFrame([(1, "w", 25), (2, "w", 24), (2, "rare", 5)], "film_id long, word string, count long")
    lines = spark.createDataFrame([("w", 1990, 49)], "word string, year int, count long")
    rows = query(SimpleNamespace(words=words, films=films, word_year=lines))
    assert {r.word for r in rows.collect()} == {"w"}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Window ")  # the join lies above the ranking


def test_cube_deals_words_before_they_are_repeated(spark, shuffled_joins):
    films = spark.createDataFrame([(1, 1999, "en", ["x", "y", "x"]), (2, 1990, "en", ["y"]), (3, None, "fr", None)], "film_id long, year int, lang string, genres array<string>")
    words = spark.createDataFrame([(1, "w", 3), (2, "w", 4), (2, "v", 1), (3, "w", 5)], "film_id long, word string, count long")
    table = cube.cube(words, films)
    got = {(r.kind, r.key, r.lang, r.word): (r["count"], r.films) for r in table.collect()}
    assert {k[:3]: v for k, v in got.items() if k[3] == "w"} == {
        ("all", "", "en"): (7, 2), ("all", "", "fr"): (5, 1), ("decades", "1990", "en"): (7, 2), ("years", "1999", "en"): (3, 1), ("years", "1990", "en"): (4, 1), ("genres", "x", "en"): (3, 1), ("genres", "y", "en"): (7, 2),
    }
    assert got["genres", "y", "en", None] == (8, 2) and got["all", "", "fr", None] == (5, 1)
    assert [keys for keys in exchanges(table) if re.search(r"\bword\b", keys)][0].split(",")[0] == "word"


def test_words_by_film_stay_where_they_are_counted(spark, sf_dir, tmp_path, shuffled_joins, monkeypatch):
    c, laid = corpus(spark, sf_dir, tmp_path), []
    monkeypatch.setattr(writers, "sorted_files", lambda df, path, *keys, **options: laid.append(df))
    writers.words_tables(c.words, str(tmp_path / "words"))
    assert laid[0].count() == laid[1].count() > 0
    laid[0].collect()
    assert "Exchange" not in laid[0]._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    c.all_films.unpersist()
    c.counts.unpersist()


def test_only_words_with_a_score_meet_the_corpus(spark):
    films = spark.createDataFrame([(1, "A")], "film_id long, title string")
    words = spark.createDataFrame([(1, "w", 25), (1, "v", 24), (1, "rare", 2)], "film_id long, word string, count long")
    meta = spark.createDataFrame([("w", 1.0, "n", "n", 0.0)], "word string, zipf double, classes string, pos string, dist double")
    made = entities.film_payloads(SimpleNamespace(words=words, dictionary=words.select("word", "count"), meta=meta, stopwords=("v",), films=films))
    page = json.loads(made.first().payload)
    assert [[(x["rank"], x["word"]) for x in page[k]] for k in ("top", "top_all")] == [[(1, "w"), (2, "rare")], [(1, "w"), (2, "v"), (3, "rare")]]
    assert {x["word"] for x in page["distinctive"]} == {"w", "v"} and all("z" not in x for x in page["top"])
    plan = re.sub(r"#\d+L?", "", made._jdf.queryExecution().optimizedPlan().toString())
    assert plan.count("Join LeftOuter") == 1 and "(count >= 3)" in plan.split("Join LeftOuter")[1]


def test_partitions_grow_with_the_documents(spark, sf_dir, tmp_path, monkeypatch):
    corpus(spark, sf_dir, tmp_path)
    monkeypatch.setattr(plans, "SHARE", 16 << 10, raising=False)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(n, None) for n in names]
    size = sum(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("*.parquet"))
    try:
        c = Corpus.of(spark, str(tmp_path))
        assert c.counts.rdd.getNumPartitions() == int(spark.conf.get(names[0])) == -(-size // (16 << 10)) > 4
        c.counts.unpersist()
        c.close()
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def test_pairs_come_from_one_ranking_of_words(spark):
    words = spark.createDataFrame([(f, f"rare{i}", 9) for f in (1, 2, 3) for i in range(6)] + [(4, "own", 9)], "film_id long, word string, count long")
    pairs = audit.suspect_pairs(words, 5, min_count=2)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2, 6), (1, 3, 6), (2, 3, 6)]
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number") == 1


def test_lists_that_are_merged_are_made_once(spark, sf_dir, tmp_path):
    c = corpus(spark, sf_dir, tmp_path)
    merged = entities.merge_signatures(c)
    assert merged.count() and "InMemoryRelation" not in merged._jdf.queryExecution().optimizedPlan().toString()  # only the lists
    assert series.merge_shifts(c).collect() and series.by_language(c).storageLevel.useMemory
    c.close()


def test_batches_deal_texts_and_not_their_words(spark, tmp_path, monkeypatch):
    sums = aggregates.RunningAggregates(spark, str(tmp_path / "s"), 3)
    texts = spark.createDataFrame([("a", 1990, "it's 'a' test, a Té'"), ("b", 1991, "a")], "film_id string, year int, text string")
    old = spark.createDataFrame([("a", 1990, "test", 2, 1, 0), ("a", 1990, "''to", 3, 1, 0), ("b", 1991, "a", 1, 1, 1)], aggregates.SAID + ", bucket int").withColumn("bucket", sums._bucket())
    change = sums._change(texts, old)
    assert sorted((r.film_id, r.word, r["count"], r.films) for r in change.collect()) == [("a", "''to", -3, -1), ("a", "a", 2, 1), ("a", "it's", 1, 1), ("a", "te'", 1, 1), ("a", "test", -1, 0)]
    assert "hashpartitioning" not in change._jdf.queryExecution().executedPlan().toString()


def test_near_dedup_leaves_texts_where_they_lie(spark, sf_dir, shuffled_joins):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert 0 < out.count() <= 60
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.split("(doc_id")[0].count("Exchange") <= 1


def test_choice_gathers_words_where_files_lie(spark, sf_dir, tmp_path, shuffled_joins):
    """Fingerprints are made where the counts lie, and vectors are dealt by film once: no shuffle by word or of words by name."""
    c = corpus(spark, sf_dir, tmp_path)
    chosen = audits.consensus_choice(c)
    assert not any("word" in keys for keys in exchanges(chosen))
    assert chosen._jdf.queryExecution().executedPlan().toString().count("repartition_by_col".upper()) == 1 and chosen.count() > 0
    c.counts.unpersist()
