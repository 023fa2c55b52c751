"""What is kept between runs: film choices, running aggregates, payloads by key, and layouts that prune."""

import pytest
from pyspark.sql import functions as F

from dialex.operators.corpus import word_counts, word_year
from dialex.plans import kept
from dialex.plans.corpus import Corpus
from dialex.sources import payloads, writers
from dialex.sources.film_cache import FilmCache, candidate_names
from dialex.streaming import aggregates

TEXTS = {"a1": "one two two", "a2": "one two three", "a3": "four", "b1": "five five", "b2": "", "c1": "six"}
FILMS = "film_id string, candidates array<string>, runtime_minutes int, context struct<min:int>"


class Desk:
    """A cache with a rule that takes the first candidate of at least context.min words, and notes what it reads."""

    def __init__(self, spark, path, prints=1, rule=1, buckets=3):
        self.spark, self.cache, self.reads, self.lost = spark, FilmCache(spark, str(path), prints, rule, buckets), [], set()

    def read(self, files):
        names = sorted(r.name for r in files.collect())
        self.reads += names
        rows = [(n[0], n, len(TEXTS[n]), w, TEXTS[n].split().count(w) if w else None) for n in names if n not in self.lost for w in [None, *sorted(set(TEXTS[n].split()))]]
        return self.spark.createDataFrame(rows, "film_id string, name string, bytes long, word string, count long")

    @staticmethod
    def fingerprint(words, sizes):
        n = words.groupBy("film_id", "name").agg(F.sum("count").alias("n"))
        return sizes.join(n, ["film_id", "name"], "left").select("film_id", "name", F.coalesce("n", F.lit(0)).alias("n"))

    @staticmethod
    def choose(files):
        good = F.when(F.col("n") >= F.col("context.min"), F.struct("rank", "name"))
        return files.groupBy("film_id").agg(F.min(good)["name"].alias("name"))

    def update(self, *films):
        self.reads = []
        df = self.spark.createDataFrame([(f, c, r, (m,)) for f, c, r, m in films], FILMS)
        self.did = self.cache.update(df, self.read, self.fingerprint, self.choose)
        return {r.film_id: r.name for r in self.cache.choices(df).collect()}, sorted(tuple(r) for r in self.cache.counts(df).collect())


A, B, C = ("a", ["a3", "a2", "a1"], 90, 1), ("b", ["b2", "b1"], None, 1), ("c", ["c1"], 5, 3)


def test_choices_are_kept_until_what_they_depend_on_changes(spark, tmp_path):
    desk = Desk(spark, tmp_path / "c")
    names, counts = desk.update(A, B, C)
    assert names == {"a": "a3", "b": "b1", "c": None} and counts == [("a", "four", 1), ("b", "five", 2)]
    assert desk.reads == ["a1", "a2", "a3", "b1", "b2", "c1"] and (desk.did.chosen, desk.did.fingerprinted, desk.did.changed) == (3, 6, 3)
    assert desk.update(A, B, C) == (names, counts) and desk.reads == [] and desk.did.chosen == 0

    names, counts = desk.update((*A[:3], 2), B, C)  # another context: one changed winner is counted, nothing else is read
    assert names["a"] == "a2" and counts[:3] == [("a", "one", 1), ("a", "three", 1), ("a", "two", 1)]
    assert desk.reads == ["a2"] and (desk.did.chosen, desk.did.fingerprinted, desk.did.reread, desk.did.changed) == (1, 0, 1, 1)
    names, _ = desk.update((*A[:2], 91, 2), B, C)  # another running time, the same winner
    assert names["a"] == "a2" and desk.reads == [] and (desk.did.chosen, desk.did.changed) == (1, 0)
    names, _ = desk.update(("a", ["a1", "a2"], 91, 2), B, C)  # another order
    assert names["a"] == "a1" and desk.reads == ["a1"]
    assert spark.read.parquet(str(tmp_path / "c" / "counts")).where("film_id = 'a'").select("name").distinct().count() == 1


def test_versions(spark, tmp_path):
    Desk(spark, tmp_path / "c").update(A, B)
    rule = Desk(spark, tmp_path / "c", rule=2)
    assert rule.update(A, B)[0] == {"a": "a3", "b": "b1"} and rule.reads == [] and rule.did.chosen == 2
    parser = Desk(spark, tmp_path / "c", prints=2, rule=2)
    parser.update(A, B)
    assert len(parser.reads) == 5 and parser.did.changed == 2
    assert {r.print_version for r in spark.read.parquet(str(tmp_path / "c" / "prints")).collect()} == {2}


def test_a_file_that_cannot_be_read_leaves_its_film_alone(spark, tmp_path):
    desk = Desk(spark, tmp_path / "c")
    desk.lost = {"a2"}
    names, counts = desk.update(A, B)
    assert names == {"b": "b1"} and desk.did.failed == 1 and counts == [("b", "five", 2)]
    desk.lost = set()
    names, counts = desk.update(A, B)
    assert names == {"a": "a3", "b": "b1"} and desk.reads.count("a2") == 1 and "b1" not in desk.reads


def test_films_are_forgotten(spark, tmp_path):
    desk = Desk(spark, tmp_path / "c", buckets=50)
    desk.update(A, B, C)
    desk.cache.forget(spark.createDataFrame([("a",), ("c",)], "film_id string"))
    for name in ("prints", "counts", "choices"):
        assert {r.film_id for r in spark.read.parquet(str(tmp_path / "c" / name)).collect()} == {"b"}
    with pytest.raises(ValueError, match="nothing chosen"):
        FilmCache(spark, str(tmp_path / "none"), 1, 1).choices(spark.createDataFrame([], FILMS))


def test_candidates_default_to_the_one_file(spark):
    df = spark.createDataFrame([(["x", "y"], "y"), ([], "z"), (None, "z")], "candidates array<string>, name string")
    assert [r.n for r in df.select(candidate_names(F.col("candidates"), F.col("name")).alias("n")).collect()] == [["x", "y"], ["z"], ["z"]]


def test_changed_context_equals_a_full_run_and_reads_changed_winners_only(spark, sf_dir):
    c = Corpus.of(spark, sf_dir)
    cache, (first, second), films = kept.rechosen(c)
    assert first.fingerprinted > 0 and first.reread == 0 and second.fingerprinted == 0
    assert second.chosen == films.where("film_id % 3 = 0").count() and second.reread == second.changed <= second.chosen
    fresh = FilmCache(spark, kept.scratch(spark, "fresh"), 1, 1, 8)
    fresh.update(films, kept._files_read(c), lambda w, s: kept.selection.fingerprints(w, s, c.stopwords, kept.TALK), kept.choose_in_context)
    assert sorted(map(tuple, cache.counts(films).collect())) == sorted(map(tuple, fresh.counts(films).collect()))


DOCS = [("f1", 1999, "the cat the", 0), ("f2", 1999, "the dog", 0), ("f3", None, "a dog", 0), (None, 1999, "lost", 0), ("f1", 1999, "the first try", -1)]


def figures(sums, floor=1):
    return sorted((tuple(r) for r in sums.word_year(floor).collect()), key=str)


def expected(spark, docs, floor=1):
    films = spark.createDataFrame([(f, y, t) for f, y, t in docs], "film_id string, year int, text string")
    return sorted((tuple(r) for r in word_year(word_counts(films), films, floor).select("word", "year", "count", "movie_count").collect()), key=str)


def test_batches_with_changes_and_removals_equal_one_run(spark, tmp_path):
    sums = aggregates.RunningAggregates(spark, str(tmp_path / "s"), 3)
    batch = lambda *rows: spark.createDataFrame(list(rows), aggregates.DOCS)
    assert figures(sums) == []
    sums.add(batch(*DOCS), 0)
    assert figures(sums) == expected(spark, [("f1", 1999, "the cat the"), ("f2", 1999, "the dog"), ("f3", None, "a dog")])
    sums.add(batch(("f2", 2001, "a cat", 1), ("f1", 1999, None, 1), ("f9", 1999, None, 1)), 1)
    now = [("f2", 2001, "a cat"), ("f3", None, "a dog")]
    assert figures(sums) == expected(spark, now)
    assert {(r.word, r["count"], r.films) for r in sums.dictionary().collect()} == {("a", 2, 2), ("cat", 1, 1), ("dog", 1, 1)}
    assert {(r.year, r.total) for r in sums.year_totals().collect()} == {(2001, 2), (None, 2)}
    sums.add(batch(("f2", 2001, "another text", 5)), 1)  # done already
    assert figures(sums) == expected(spark, now)
    sums.compact()
    assert figures(sums) == expected(spark, now) and len(sums._done()["folders"]) == 1
    sums.add(batch(("f3", None, "a a a", 9)), 2)
    assert figures(sums, 4) == expected(spark, [("f2", 2001, "a cat"), ("f3", None, "a a a")], 4) and figures(sums, 5) == []


def test_a_batch_that_failed_half_way_counts_once(spark, tmp_path, monkeypatch):
    sums = aggregates.RunningAggregates(spark, str(tmp_path / "s"), 3)
    docs = spark.createDataFrame(DOCS, aggregates.DOCS)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(sums, "_list", fail)
        with pytest.raises(OSError, match="lost"):
            sums.add(docs, 0)
    assert figures(sums) == []
    sums.add(docs, 0)
    assert figures(sums) == expected(spark, [("f1", 1999, "the cat the"), ("f2", 1999, "the dog"), ("f3", None, "a dog")])


def test_stream_of_batches(spark, tmp_path):
    sums = aggregates.RunningAggregates(spark, str(tmp_path / "s"), 3, compact_after=2)
    for i, rows in enumerate([DOCS[:2], [("f2", 2001, "a cat", 1)], [("f1", 1999, None, 2)]]):
        spark.createDataFrame(rows, aggregates.DOCS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sums.stream(str(tmp_path / "in"), str(tmp_path / "cp"), 1).awaitTermination(120)
        assert len(sums._done()["batches"]) == i + 1
    assert figures(sums) == expected(spark, [("f2", 2001, "a cat")])


def scans(df):
    """(rows and folders read, plan) of the one file scan of a query without an exchange, from Spark's own figures."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    seen = plan.collectLeaves().apply(0).metrics()
    folders = seen.get("numPartitions")
    return seen.apply("numOutputRows").value(), folders.get().value() if folders.isDefined() else 0, plan.toString()


def test_payloads_are_read_from_one_folder(spark, tmp_path):
    store, blurbs = payloads.PayloadStore(spark, str(tmp_path / "p"), 16), payloads.PayloadStore(spark, str(tmp_path / "b"), 16)
    rows = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("payload "), "id").alias("payload"))
    store.write(rows.unionAll(spark.createDataFrame([(None, "lost")], "key string, payload string")))
    got = store.get("k77")
    read, folders, plan = scans(got)
    assert read <= 20000 / 16 * 1.2 and folders == 1 and "PartitionFilters: [isnotnull(bucket" in plan
    assert [tuple(r) for r in got.collect()] == [("k77", "payload 77")]
    assert scans(store.get("none"))[0] <= 20000 / 16 * 1.2 and store.get("none").count() == 0
    assert store.one("k5", blurb=blurbs) == {"key": "k5", "payload": "payload 5", "blurb": None}
    blurbs.write(rows.where("key = 'k5'").select("key", F.lit("short").alias("payload")))
    assert store.one("k5", blurb=blurbs)["blurb"] == "short" and store.one("k6", blurb=blurbs)["blurb"] is None and store.one("no") is None
    asked = spark.createDataFrame([("k5",), ("k6",), ("no",), (None,)], "key string")
    assert sorted(store.look_up(asked, blurb=blurbs).collect(), key=str) == sorted([("k5", "payload 5", "short"), ("k6", "payload 6", None), ("no", None, None), (None, None, None)], key=str)


def test_requests_take_the_way_of_their_languages(spark, tmp_path):
    baked = payloads.BakedSlices(spark, str(tmp_path), "lines")
    baked.write(spark.createDataFrame([("all", 1, 10), ("en", 1, 6), ("de", 1, 3), ("zh", 1, 1)], "slice string, year int, n int"))
    merge = lambda parts: kept.slices.merge_by_year(parts, "n")
    assert [[tuple(r) for r in baked.ask(a, merge).collect()] for a in ([], ["en"], ["en", "de"], ["cn", "zh"])] == [[(1, 10)], [(1, 6)], [(1, 9)], [(1, 1)]]


def test_a_film_and_a_word_touch_few_rows(spark, sf_dir, tmp_path):
    """The two orders of the words: a read for one film, or one word, skips the rest by least and largest values."""
    words = Corpus.of(spark, sf_dir).words
    writers.words_tables(words, str(tmp_path))
    total = words.count()
    for name, key in (("words_by_movie", F.col("film_id") == 17), ("words_by_word", F.col("word") == "hand")):
        got = spark.read.parquet(str(tmp_path / name)).where(key)
        read, *_ = scans(got)
        assert got.count() == words.where(key).count() > 0
        assert read < 0.05 * total, (name, read, total)
