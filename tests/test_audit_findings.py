"""All checks of quality as one table, against a baseline."""

from dialex.operators import audit

FILMS = "film_id string, title string, year int, genres array<string>, runtime_minutes int"


def films(spark):
    curated = spark.createDataFrame([("a", "A", 1950, ["Drama"], 90), ("b", "B", 1999, ["Documentary"], 90), ("c", "C", 1920, None, 90), ("d", "D", 1999, ["Drama"], None), ("e", "E", 1999, ["Drama"], 90)], FILMS)
    chosen = spark.createDataFrame([("a", "ok", ["x"], "single", "a1"), ("b", None, [], "rank", "b1"), ("c", "ok", [], "rank", "c1"), ("d", "low", ["asr"], "rank", "d1"), ("zz", "ok", [], "rank", "z")], "film_id string, tier string, flags array<string>, reason string, name string")
    languages = spark.createDataFrame([("a", "en"), ("b", "fr"), ("d", "en")], "film_id string, lang string")
    stats = spark.createDataFrame([("a", 900, 10.0), ("b", 20000, 222.26), ("c", 9000, 100.0), ("d", 1, 900.0)], "film_id string, total_words long, words_per_minute double")
    return chosen, audit.audited_films(chosen, curated, languages, stats)


WORDS = [("a", "email", 2), ("a", "google", 5), ("a", "shithead", 3), ("a", "shittim", 9), ("b", "google", 1), ("c", "email", 1), ("d", "email", 9), ("b", "fuck", 4)]


def test_selection_is_joined_with_what_is_known(spark):
    chosen, got = films(spark)
    rows = {r.film_id: r for r in got.collect()}
    assert set(rows) == {"a", "b", "c", "d"} and rows["b"].quality == "ok" and rows["c"].lang is None and rows["d"].total_words == 1
    assert audit.audited_films(chosen.drop("tier", "flags"), got.select("film_id", "title", "year", "genres", "runtime_minutes"), got.select("film_id", "lang"), got.select("film_id", "total_words", "words_per_minute")).where("quality <> 'ok'").count() == 0


def test_findings_from_one_pass(spark):
    words = spark.createDataFrame(WORDS, "film_id string, word string, count long")
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", None), ("d", 0.5)], "film_id string, mt_score double")
    verified = spark.createDataFrame([("a",)], "film_id string")
    got = {(r.canary, r.film_id): dict(r.figures) for r in audit.findings(films(spark)[1], words, scores, verified).collect()}
    assert got == {
        ("profanity", "a"): {"hits": "3", "words": "shithead x3", "verified": "true"}, ("anachronisms", "a"): {"words": "google x5, email x2"}, ("anachronisms", "c"): {"words": "email x1"},
        ("rates", "b"): {"wpm": "222.3", "total_words": "20000"}, ("silent_rates", "c"): {"wpm": "100.0", "total_words": "9000"}, ("grey_zone", "a"): {"mt_score": "0.5"},
    }
    assert audit.findings(films(spark)[1], words.limit(0)).where("canary IN ('profanity', 'anachronisms', 'grey_zone')").count() == 0


def test_changes_against_a_baseline(spark):
    words = spark.createDataFrame(WORDS, "film_id string, word string, count long")
    now = audit.findings(films(spark)[1], words)
    before = audit.findings(films(spark)[1].where("film_id <> 'c'"), words.unionAll(spark.createDataFrame([("b", "email", 1)], words.schema)), first_years={"email": 2005, "google": 1998})
    compared = audit.against_baseline(now, before)
    assert {(r.canary, r.film_id): r.change for r in compared.collect()} == {
        ("profanity", "a"): "same", ("anachronisms", "a"): "same", ("anachronisms", "b"): "gone", ("anachronisms", "c"): "new", ("rates", "b"): "same", ("silent_rates", "c"): "new",
    }
    assert {tuple(r) for r in audit.tally(compared).collect()} == {("profanity", 1, 0, 0), ("anachronisms", 2, 1, 1), ("rates", 1, 0, 0), ("silent_rates", 1, 1, 0), ("grey_zone", 0, 0, 0)}
    text = audit.report(compared, top=1)
    assert "## anachronisms: 2\nvs baseline: +1 new, -1 gone\n- 1920 C (c): words=email x1\n- and 1 more" in text and "## grey_zone: 0" in text
