"""Per-text quality features, and what is concluded from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialex.functions.lexicon import CONTRACTIONS, STRONG_PROFANITY
from dialex.functions.stats import logistic_score

# What counts as punctuation, an ended line, other scripts, and mis-decoded text.
PUNCT, END_PUNCT = r"[.,!?;:…]", r"[.!?…:;,\"'”»\-–—)]\s*$"
NON_LATIN, MOJIBAKE = "[^\\x00-\\u024F\\u2000-\\u206F♪♫]", "Ã.|â€"


def line_features(docs: DataFrame) -> DataFrame:
    """(film_id, lines, cap_start, end_punct, punct, non_latin, mojibake, letters) of docs(film_id, text), a line a
    sentence."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    n = F.greatest(F.size("_l"), F.lit(1))
    first = lambda x: F.substring(F.regexp_replace(x, "^[-–\"' ]+", ""), 1, 1)
    share = lambda f: F.round(F.size(F.filter("_l", f)) / n, 4)
    d = docs.select("film_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_l", lines)
    return d.select(
        "film_id", F.size("_l").alias("lines"), share(lambda x: first(x).rlike(r"^\p{Lu}")).alias("cap_start"), share(lambda x: x.rlike(END_PUNCT)).alias("end_punct"),
        F.regexp_count("text", F.lit(PUNCT)).alias("punct"), F.regexp_count("text", F.lit(NON_LATIN)).alias("non_latin"), F.regexp_count("text", F.lit(MOJIBAKE)).alias("mojibake"), F.regexp_count("text", F.lit(r"\p{L}")).alias("letters"),
    )


def style_counts(words: DataFrame, style_words: Iterable[str]) -> DataFrame:
    """(film_id, style): counts of style words, and of each contraction ending as *ending."""
    listed = words.where(F.col("word").isin(*style_words)).select("film_id", F.col("word").alias("key"), "count")
    ends = [words.where(F.col("word").endswith(s)).select("film_id", F.lit("*" + s).alias("key"), "count") for s in CONTRACTIONS]
    for e in ends:
        listed = listed.unionByName(e)
    summed = listed.groupBy("film_id", "key").agg(F.sum("count").alias("n"))
    return summed.groupBy("film_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("style"))


def features(docs: DataFrame, words: DataFrame, style_words: Iterable[str] = (), profanity: Iterable[str] = (), repaired: DataFrame | None = None) -> DataFrame:
    """A row a text with the features that flags and calibration need."""
    sums = words.groupBy("film_id").agg(F.sum("count").alias("tokens"))
    swears = words.where(F.col("word").isin(*profanity)).groupBy("film_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "count")))).alias("profanity"))
    out = line_features(docs).join(sums, "film_id", "left").join(style_counts(words, style_words), "film_id", "left").join(swears, "film_id", "left")
    if repaired is not None:
        out = out.join(repaired.select("film_id", "repaired"), "film_id", "left")
    else:
        out = out.withColumn("repaired", F.lit(0))
    t, letters = F.coalesce("tokens", F.lit(0)), F.greatest("letters", F.lit(1))
    some = F.greatest(t, F.lit(1))
    return out.select(
        "film_id", t.alias("tokens"), "lines", F.round(t / F.greatest("lines", F.lit(1)), 3).alias("toks_per_line"), "cap_start", "end_punct", F.round(F.col("punct") / some, 4).alias("punct_per_tok"),
        F.round(1000 * F.col("non_latin") / letters, 3).alias("non_latin_k"), F.round(1000 * F.col("mojibake") / letters, 3).alias("mojibake_k"), F.round(1000 * F.coalesce("repaired", F.lit(0)) / some, 3).alias("ocr_repaired_k"), "style", "profanity",
    )


def is_asr() -> Column:
    """Automatic captions: long lines, few capitals, little punctuation at line ends."""
    return (F.col("toks_per_line") >= 12) & (F.col("cap_start") < 0.75) & (F.col("end_punct") < 0.6)


def strong_profanity(words: DataFrame) -> DataFrame:
    return words.where(F.col("word").rlike(STRONG_PROFANITY)).groupBy("film_id").agg(F.sum("count").alias("profane"))


def style_rates(tokens: Column, style: Column, names: list[str]) -> Column:
    """Rates per thousand words of the named style features, then the share of contracted negations."""
    of = lambda k: F.coalesce(F.try_element_at(style, F.lit(k)), F.lit(0)).cast("double")
    rates = [1000 * of(k) / F.greatest(tokens, F.lit(1)) for k in names]
    return F.array(*rates, of("*n't") / (of("*n't") + of("not") + 1))


def mt_scores(featured: DataFrame, model: dict, min_tokens: int = 1000) -> DataFrame:
    """(film_id, mt_score): how likely a text is a machine translation by its function words; null for short texts."""
    score = logistic_score(style_rates(F.col("tokens"), F.col("style"), model["features"]), model)
    return featured.select("film_id", F.when(F.col("tokens") >= min_tokens, score).alias("mt_score"))
