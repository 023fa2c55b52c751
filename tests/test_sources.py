"""Readers, writers, the count cache and the stream."""

import gzip
import json

from pyspark.sql import functions as F

from dialex.operators.corpus import curated, pick_certification, word_counts
from dialex.sources import readers, writers
from dialex.streaming import incremental


def test_curated_from_dumps(spark, tmp_path):
    basics = "tconst\ttitleType\tprimaryTitle\tstartYear\truntimeMinutes\tgenres\ntt1\tmovie\tA \"quoted\" film\t1999\t\\N\tDrama,Crime\ntt2\tshort\tB\t1999\t10\tDrama\ntt3\tmovie\tC\t\\N\t90\tDrama\ntt4\tmovie\tD\t2000\tx\t\\N\n"
    ratings = "tconst\taverageRating\tnumVotes\ntt1\t7.5\t1000\ntt2\t7.5\t1000\ntt3\t7.5\t1000\ntt4\t6.0\t299\n"
    for name, data in (("b", basics), ("r", ratings)):
        with gzip.open(tmp_path / f"{name}.tsv.gz", "wt") as f:
            f.write(data)
    got = curated(readers.tsv(spark, str(tmp_path / "b.tsv.gz")), readers.tsv(spark, str(tmp_path / "r.tsv.gz"))).collect()
    assert [(r.film_id, r.title, r.year, r.runtime_minutes, r.genres, r.votes) for r in got] == [("tt1", 'A "quoted" film', 1999, None, ["Drama", "Crime"], 1000)]


def test_json_objects_skip_null_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"film_id": "tt1",\n "lang": "en"}')
    (tmp_path / "b.json").write_text("null")
    assert [r.film_id for r in readers.json_objects(spark, str(tmp_path), "film_id string, lang string").collect()] == ["tt1"]


def test_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# remark\n\nthe\n of \nthe\n")
    assert sorted(r.word for r in readers.word_list(spark, str(tmp_path / "l.txt")).collect()) == ["of", "the"]
    (tmp_path / "b.txt").write_text("# ids\ntt1\ntt2 a.xml wrong film\n")
    ids, files = readers.block_list(spark, str(tmp_path / "b.txt"))
    assert [r.film_id for r in ids.collect()] == ["tt1"]
    assert [tuple(r) for r in files.collect()] == [("tt2", "a.xml")]
    assert [r.word for r in readers.ordered_words(spark, ["b", "a", "b"]).orderBy("place").collect()] == ["b", "a"]


def test_dialogue(spark, tmp_path):
    sep = " +++$+++ "
    (tmp_path / "l.txt").write_bytes(sep.join(["L1", "u0", "m0", "BIANCA", "Caf\xe9 now."]).encode("latin-1") + b"\n")
    (tmp_path / "m.txt").write_bytes(sep.join(["m0", "don't look", "1999/I", "6.9", "627", "['comedy', 'comedy', 'war']"]).encode("latin-1") + b"\n")
    lines = readers.dialogue_lines(spark, str(tmp_path / "l.txt"))
    assert lines.first().text == "Café now."
    f = readers.dialogue_films(spark, str(tmp_path / "m.txt")).first()
    assert (f.title, f.year, f.votes, f.genres) == ("Don't Look", 1999, 627, ["Comedy", "War"])
    assert readers.dialogue_docs(lines, 2).count() == 1 and readers.dialogue_docs(lines, 3).count() == 0


def test_detail_record(spark):
    raw = {"id": 5, "overview": "O", "genres": [{"name": "Drama"}, {"name": ""}], "credits": {"cast": [{"name": "B", "order": None}, {"name": "A", "character": "X", "order": 1}], "crew": [{"name": "D", "job": "Director"}, {"name": "D", "job": "Director"}, {"name": "W", "job": "Story"}]}}
    df = spark.createDataFrame([(json.dumps(raw),), ("{}",)], "raw string").select(readers.detail_record(F.col("raw")).alias("r"))
    full, empty = (r.r for r in df.collect())
    assert ([c.name for c in full.cast], full.director, full.writers, full.tmdb_genres, full.runtime) == (["A", "B"], ["D"], ["W"], ["Drama"], 0)
    assert (empty.overview, empty.cast, empty.keywords, empty.composer) == ("", [], [], None)
    assert json.loads(df.select(readers.blurb(F.col("r")).alias("b")).first().b) == {"overview": "O"}


def test_sorted_tables_and_documents(spark, tmp_path):
    words = spark.createDataFrame([("a", "x", 1), ("a", "y", 5), ("b", "x", 2)], "film_id string, word string, count long")
    writers.words_tables(words, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "words_by_word")).count() == 3
    writers.documents(spark.createDataFrame([("k", "{}")], "key string, payload string"), str(tmp_path / "d"))
    assert readers.ndjson(spark, str(tmp_path / "d")).first().key == "k"
    assert json.loads(writers.small_json(words.where("film_id = 'b'"))) == [{"film_id": "b", "word": "x", "count": 2}]
    writers.selection_table(spark.createDataFrame([("a", ["x"])], "film_id string, flags array<string>"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).first().flags == '["x"]'


def test_stream_counts_each_document_once(spark, tmp_path):
    cache = writers.CountCache(spark, str(tmp_path / "cache"), 1)
    docs = spark.createDataFrame([("a", "the cat the"), ("b", "a dog"), ("c", "..."), ("d", None), (None, "lost")], incremental.DOCS)
    docs.write.parquet(str(tmp_path / "in"))
    incremental.count_stream(spark, str(tmp_path / "in"), cache, str(tmp_path / "cp")).awaitTermination(120)
    docs.write.mode("append").parquet(str(tmp_path / "in"))
    incremental.count_stream(spark, str(tmp_path / "in"), cache, str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(tuple(r) for r in cache.read().select("film_id", "word", "count").collect())
    assert got == sorted(tuple(r) for r in word_counts(docs.where("film_id IS NOT NULL")).collect())
    assert cache.missing(docs.where("film_id IS NOT NULL").withColumn("inputs", cache.inputs("text"))).isEmpty()
    changed = spark.createDataFrame([("a", "new text")], incremental.DOCS).withColumn("inputs", cache.inputs("text"))
    assert cache.missing(changed).count() == 1
    assert writers.CountCache(spark, str(tmp_path / "cache"), 2).read().count() == 0


def test_running_totals(spark, tmp_path):
    spark.createDataFrame([("a", "the cat the")], incremental.DOCS).write.parquet(str(tmp_path / "in"))
    incremental.running_totals(spark, str(tmp_path / "in"), str(tmp_path / "totals"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.word: r["count"] for r in incremental.totals(spark, str(tmp_path / "totals")).collect()} == {"the": 2, "cat": 1}
    for i in range(3):
        spark.createDataFrame([("b", "the dog")], incremental.DOCS).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.running_totals(spark, str(tmp_path / "in"), str(tmp_path / "totals"), str(tmp_path / "cp")).awaitTermination(120)
        assert {r.word: r["count"] for r in incremental.totals(spark, str(tmp_path / "totals")).collect()} == {"the": 3 + i, "cat": 1, "dog": 1 + i}
    (tmp_path / "totals" / "version=9").mkdir()  # a write that failed
    assert incremental.totals(spark, str(tmp_path / "totals")).count() == 3


def test_details_that_drift(spark, tmp_path):
    lines = [
        {"film_id": "a", "fetched_at": "2025", "detail": {"id": "5", "runtime": "90", "genres": {"name": "Drama"}, "overview": "old"}},
        {"film_id": "a", "fetched_at": "2026", "detail": {"id": 5, "runtime": {"m": 90}, "genres": [{"name": "Drama"}, {"name": 7}], "overview": "new", "belongs_to_collection": "none", "credits": {"cast": "nobody"}}},
        {"film_id": "b", "fetched_at": None, "detail": None}, {"film_id": None, "detail": {"id": 1}}, {"film_id": 9, "detail": {"runtime": "long", "adult": "true", "popularity": "1.5"}},
    ]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    landed = readers.landed_details(spark, str(tmp_path / "d.json"))
    assert sorted((r.film_id, r.fetched_at) for r in landed.select("film_id", "fetched_at").collect() if r.fetched_at) == [("a", "2025"), ("a", "2026")]
    got = {r.film_id: r.r for r in readers.latest(landed, "film_id", "fetched_at").select("film_id", readers.drifting_record(F.col("detail")).alias("r")).collect()}
    assert set(got) == {"a", "9"}
    assert (got["a"].tmdb_id, got["a"].runtime, got["a"].overview, got["a"].tmdb_genres, got["a"].collection_name, got["a"].cast) == (5, 0, "new", ["Drama", "7"], None, [])
    assert (got["9"].runtime, got["9"].adult, got["9"].tmdb_popularity, got["9"].tmdb_genres) == (0, True, 1.5, [])


def test_the_latest_row_of_a_key(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 1), ("a", 2, 3), ("b", None, 1), (None, 1, 1)], "k string, at int, n int")
    assert sorted(map(tuple, readers.latest(df, "k", "at", "n").collect()), key=str) == sorted([("a", 2, 3), ("b", None, 1), (None, 1, 1)], key=str)


def test_release_entries(spark, tmp_path):
    lines = [{"film_id": "a", "us": [{"type": 1, "certification": "PG"}, {"type": 3, "release_date": "1999", "certification": "R"}]}, None, {"film_id": "b", "us": []}, {"film_id": "c"}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)))
    got = readers.release_entries(spark, str(tmp_path / "r.json")).select("film_id", pick_certification(F.col("entries")).alias("c"))
    assert sorted(map(tuple, got.collect())) == [("a", "r"), ("b", None), ("c", None)]
