"""Tokeniser, cleaning, repair: one case an artifact."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialex.functions import text
from dialex.operators.corpus import word_counts

TOKENS = [
    ("Don't stop", ["don't", "stop"]),
    ("don’t ‘stop’", ["don't", "stop"]),
    ("she said 'no way' to him", ["she", "said", "no", "way", "to", "him"]),
    ("'tis on", ["'tis", "on"]),
    ("goin' on", ["goin'", "on"]),
    ("don''t", ["don't"]),
    ("café naïve", ["cafe", "naive"]),
    ("1950s 42nd b2b", []),
    ("u r a I x", ["a", "i"]),
    ("well-known", ["well", "known"]),
    ("Привет мир ok", ["ok"]),
    ("", []),
]


@pytest.mark.parametrize(("given_text", "expected"), TOKENS)
@pytest.mark.parametrize("exact", [False, True])
def test_tokens(spark, given_text, expected, exact):
    df = spark.createDataFrame([(given_text,)], "t string").select(text.tokens(F.col("t"), exact).alias("w"))
    assert df.first().w == expected


def test_tokens_of_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(text.tokens(F.col("t")).alias("w")).first().w == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB'é- .1ß_ñ’", max_size=30), min_size=1, max_size=20))
def test_tokens_are_of_the_alphabet_and_counts_add_up(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "film_id long, text string")
    words = [w for r in docs.select(text.tokens(F.col("text")).alias("w")).collect() for w in r.w]
    assert all(set(w) <= set("abcdefghijklmnopqrstuvwxyz'") for w in words)
    assert (word_counts(docs).agg(F.sum("count")).first()[0] or 0) == len(words)


LINES = [
    ("<i>Hello</i> there", "Hello there"),
    (r"{\an8}Up here", "Up here"),
    ('font color="#00ff00" green /font', "green"),
    ("What font is that?", "What font is that?"),
    ("Ben &amp; Jerry nbsp", "Ben Jerry"),
    ("Subtitles by Someone", None),
    ("Synced and corrected by X", None),
    ("They move in sync, driven by love", "They move in sync, driven by love"),
    ("# la la #", None),
    ("Suite #300", "Suite #300"),
    ("[door slams] Who's (sighs) there?", "Who's there?"),
    ("- Hello. - General!", "Hello. General!"),
    ("well-known", "well-known"),
    ("© P@rM", None),
    ("♪ song", None),
]


@pytest.mark.parametrize(("line", "expected"), LINES)
def test_clean_line(spark, line, expected):
    assert spark.createDataFrame([(line,)], "t string").select(text.clean_line(F.col("t")).alias("c")).first().c == expected


def test_xml_sentences(spark):
    xml = '<document><s id="1"><time id="T1"/>Hello\n  world</s><s id="2">Bye</s></document>'
    df = spark.createDataFrame([(xml,), ("<broken",), (None,)], "x string").select(text.xml_sentences(F.col("x")).alias("s"))
    assert [r.s for r in df.collect()] == [["Hello world", "Bye"], [], []]


def test_ids_from_paths(spark):
    paths = ["OpenSubtitles/raw/en/1999/123/1.xml", "OpenSubtitles/raw/en/1999/12345678/1.xml", "other/1.xml"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(text.film_id_from_path(F.col("p")).alias("i"))
    assert [r.i for r in df.collect()] == ["tt0000123", "tt12345678", None]


def test_ocr_repair_needs_markers(spark):
    zipf = spark.createDataFrame([("if", 6.0), ("like", 6.0), ("ian", 3.5), ("lan", 3.0)], "word string, zipf double")
    rows = [(1, "l'm", 3), (1, "lf", 4), (1, "iike", 2), (1, "lan", 5), (1, "iii", 2), (2, "lf", 4), (2, "l'm", 1)]
    got = {(r.film_id, r.word): r["count"] for r in text.ocr_repair(spark.createDataFrame(rows, "film_id long, word string, count long"), zipf).collect()}
    assert got == {(1, "l'm"): 3, (1, "if"): 4, (1, "like"): 2, (1, "lan"): 5, (1, "iii"): 2, (2, "lf"): 4, (2, "l'm"): 1}


def test_stretched_words(spark):
    df = spark.createDataFrame([("sooo",), ("book",)], "w string").select(text.is_stretched(F.col("w")).alias("s"), text.collapse(F.col("w")).alias("c"))
    assert [(r.s, r.c) for r in df.collect()] == [(True, "so"), (False, "bok")]


def test_name_tokens(spark):
    rows = [("Dr. José Ríos (voice)", "X"), ("Himself", "Ann Lee"), (None, "Bob Stone")]
    df = spark.createDataFrame(rows, "c string, a string").select(text.name_tokens(F.col("c"), F.col("a"), ("the",)).alias("n"))
    assert [sorted(r.n) for r in df.collect()] == [["jose", "rios"], ["ann", "lee"], ["bob", "stone"]]


def test_machine_translated_flag(spark):
    rows = [("<meta><machine_translated>1</machine_translated>",), ("<machine_translated>1</machine_translated>",), (None,)]
    df = spark.createDataFrame(rows, "x string").select(text.machine_translated_flag(F.col("x")).alias("f"))
    assert [r.f for r in df.collect()] == [1, None, None]
