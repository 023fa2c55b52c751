"""Cleaning and tokenising of text as expressions that stay in the JVM, and Arrow functions for the two steps that no
built-in function has: XML sentences and full compatibility decomposition."""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialex.functions.lexicon import OCR_MARKERS, OCR_MIN_GAIN, OCR_MIN_MARKERS, OCR_MIN_ZIPF

# What is stripped from subtitle lines, and which lines go.
TAGS = r"<[^>]+>"
SSA_BLOCKS = r"\{\\[^}]*\}"
FONT_TAGS = r"""(?i)(?<![\w/])/?font(?:\s+(?:color|face|size)\s*=\s*(?:"[^"]*"|'[^']*'|\S+))+|(?<![\w])/font\b"""
ENTITIES = r"(?i)&(?:nbsp|amp|quot|lt|gt|#\d+);|\bnbsp\b"
BRACKETS = r"[\[(][^\])]*[\])]"
CREDITS = r"(?i)subtitles?\s+by|subs\s+by|^\s*sync\w*\b.{0,20}?\bby\b|corrections?\s+by|encoded\s+by|opensubtitles|addic7ed|www\.|https?://|©|\w@\w"
MUSIC = r"[♪♫]|^\s*#"
SPEAKER_DASH = r"(?:^|\s)-\s+"
TOKEN_GAP = r"[^\p{L}\p{N}_']+"
TOKEN = r"^[a-z']+$"


@cache
def _fold_table() -> tuple[str, str]:
    """Letters whose decomposition without marks is one character, and those characters, for the code points below
    U+2200; derived by rule."""
    pairs = []
    for code in range(0xA0, 0x2200):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(code):
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Accented letters without their accents (single code points and combining marks)."""
    return F.regexp_replace(F.translate(text, *_fold_table()), r"\p{Mn}+", "")


@F.pandas_udf(T.StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    """Compatibility decomposition with combining marks dropped, for text with ligatures or rarer forms."""
    return text.map(lambda s: s if s is None or s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def normalise(text: Column, exact: bool = False) -> Column:
    """Lower case, one kind of apostrophe and no doubled ones, quotation pairs unwrapped, accents folded."""
    low = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.translate(low, "’‘", "''"), "''+", "'")
    t = F.regexp_replace(t, r"(?U)(?<!\w)'([^'\n]+)'(?!\w)", "$1")
    t = F.when(low.contains("'") | low.contains("’") | low.contains("‘"), t).otherwise(low)
    return fold_exact(t) if exact else F.when(F.octet_length(t) == F.length(t), t).otherwise(fold(t))


def tokens(text: Column, exact: bool = False) -> Column:
    """The words of a text, an array: runs of a-z and apostrophes that touch no other letter, digit or underscore, without
    wrapping quotes; of single letters only a and i."""
    raw = F.filter(F.split(normalise(text, exact), TOKEN_GAP), lambda w: w.rlike(TOKEN))
    bare = F.transform(raw, lambda w: F.when(w.rlike("^'.*'$") & (F.length(w) > 1), F.btrim(w, F.lit("'"))).otherwise(w))
    return F.filter(bare, lambda w: (F.length(F.btrim(w, F.lit("'"))) > 1) | F.btrim(w, F.lit("'")).isin("a", "i"))


def token_rows(docs: DataFrame, key: str | tuple[str, ...], text_col: str, exact: bool = False) -> DataFrame:
    """(key, word): the `tokens` of each text as rows, filtered in generated code and not in arrays. A key may have several
    columns.

    The text is normalised in a step of its own, where Spark works out what expressions share once; in a generator it
    would do so again for each use. Texts of ASCII too are split by the class with Unicode properties: that is several
    times as fast as a split by `[^a-z0-9_']+`, which finds the same.
    """
    word, keys = F.col("word"), [key] if isinstance(key, str) else [*key]
    plain = docs.select(*keys, normalise(F.col(text_col), exact).alias("_text"))
    raw = plain.select(*keys, F.explode(F.split("_text", TOKEN_GAP)).alias("word")).where(word.rlike(TOKEN))
    wrapped = word.startswith("'") & word.endswith("'") & (F.length(word) > 1)
    bare = raw.select(*keys, F.when(wrapped, F.btrim(word, F.lit("'"))).otherwise(word).alias("word"))
    letters = F.when(word.contains("'"), F.btrim(word, F.lit("'"))).otherwise(word)
    return bare.where((F.length(letters) > 1) | letters.isin("a", "i"))


def clean_line(line: Column) -> Column:
    """A subtitle line without markup; null for credit and music lines, which go, and for lines with nothing left."""
    t = F.trim(F.regexp_replace(line, r"\s+", " "))
    for pattern in (TAGS, SSA_BLOCKS, FONT_TAGS, ENTITIES):
        t = F.regexp_replace(t, pattern, " ")
    gone = t.rlike(CREDITS) | t.rlike(MUSIC)
    kept = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, BRACKETS, " "), SPEAKER_DASH, " "), r"\s+", " "))
    return F.when(~gone & (kept != ""), kept)


def clean_text(lines: Column) -> Column:
    """An array of lines as text, a cleaned line each."""
    return F.array_join(F.filter(F.transform(lines, clean_line), lambda x: x.isNotNull()), "\n")


@F.pandas_udf(T.ArrayType(T.StringType()))
def xml_sentences(content: pd.Series) -> pd.Series:
    """The text of each <s> element of XML documents (bytes or strings); a malformed document has none."""

    def of(raw):
        try:
            root = ElementTree.fromstring(raw)
        except (ElementTree.ParseError, TypeError):
            return []
        return [" ".join("".join(s.itertext()).split()) for s in root.iter("s")]

    return content.map(of)


def machine_translated_flag(raw: Column) -> Column:
    """The 0/1 flag after the last <meta, or null."""
    return F.regexp_extract(F.when(raw.contains("<meta"), F.substring_index(raw, "<meta", -1)), r"<machine_translated>\s*(\d)\s*<", 1).try_cast("int")


def film_id_from_path(path: Column) -> Column:
    """tt and the id padded to seven digits, from .../raw/<lang>/<year>/<id>/<n>.xml; null for other paths."""
    digits = F.nullif(F.regexp_extract(path, r"/raw/[a-z_]+/\d{4}/(\d+)/\d+\.xml$", 1), F.lit(""))
    return F.concat(F.lit("tt"), F.lpad(digits, F.greatest(F.length(digits), F.lit(7)), "0"))


def ocr_variants(token: Column) -> Column:
    """The words a token with confused I and l may stand for, sorted; none for tokens of only those letters."""
    doubled = F.when(token.contains("ii"), F.regexp_replace(token, "ii", "ll"))
    start = F.filter(F.array(token, doubled), lambda t: t.isNotNull())
    swapped = F.transform(start, lambda t: F.when(t.startswith("l"), F.concat(F.lit("i"), F.substr(t, F.lit(2)))).when(t.startswith("i") & (F.length(t) > 1), F.concat(F.lit("l"), F.substr(t, F.lit(2)))))
    found = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(doubled), swapped), lambda t: t.isNotNull())))
    return F.when(F.regexp_replace(token, "[il]", "") == "", F.array().cast("array<string>")).otherwise(found)


def ocr_repair(counts: DataFrame, zipf: DataFrame) -> DataFrame:
    """Repaired (film_id, word, count, repaired) from (film_id, word, count) and (word, zipf).

    Only films with enough tokens that must be misreadings are touched. Variants are looked up for the distinct tokens
    of those films; the commonest variant replaces a token if it is common, and much commoner than the token.
    """
    marked = counts.groupBy("film_id").agg(F.sum(F.when(F.col("word").isin(*OCR_MARKERS), F.col("count")).otherwise(0)).alias("m")).where(F.col("m") >= OCR_MIN_MARKERS).select("film_id")
    damaged = counts.join(marked, "film_id", "left_semi")
    words = damaged.select("word").distinct().withColumn("v", F.explode(ocr_variants(F.col("word"))))
    scored = words.join(zipf.select(F.col("word").alias("v"), F.col("zipf").alias("zv")), "v", "left").join(zipf.select("word", F.col("zipf").alias("zw")), "word", "left")
    scored = scored.withColumns({"zv": F.coalesce("zv", F.lit(0.0)), "zw": F.coalesce("zw", F.lit(0.0))})
    best = scored.groupBy("word").agg(F.min(F.struct((-F.col("zv")).alias("z"), "v")).alias("b"), F.first("zw").alias("zw"))
    fixes = best.where((-F.col("b.z") >= OCR_MIN_ZIPF) & (-F.col("b.z") - F.col("zw") >= OCR_MIN_GAIN)).select("word", F.col("b.v").alias("fix"))
    mended = damaged.join(fixes, "word", "left").select("film_id", F.coalesce("fix", "word").alias("word"), "count", F.when(F.col("fix").isNotNull(), F.col("count")).otherwise(0).alias("repaired"))
    whole = counts.join(marked, "film_id", "left_anti").select("film_id", "word", "count", F.lit(0).cast("long").alias("repaired"))
    return mended.unionByName(whole).groupBy("film_id", "word").agg(F.sum("count").alias("count"), F.sum("repaired").alias("repaired"))


def collapse(word: Column) -> Column:
    """Runs of a repeated letter squashed to one."""
    return F.regexp_replace(word, r"(\p{L})\1+", "$1")


def is_stretched(word: Column) -> Column:
    """True for words with a letter three times or more in a row."""
    return word.rlike(r"(\p{L})\1\1")


def word_key(word: Column) -> Column:
    """A word as a path segment by RFC 3986."""
    k = F.regexp_replace(F.url_encode(word), r"\+", "%20")
    return F.regexp_replace(F.regexp_replace(k, "%7E", "~"), r"\*", "%2A")


def title_case(title: Column) -> Column:
    """Words capitalised; letters after an apostrophe stay small, as they start no word."""
    return F.initcap(F.lower(title))


def name_tokens(character: Column, actor: Column, stopwords: tuple[str, ...]) -> Column:
    """Lower-case name tokens of three letters or more from a character's name, or from the actor's where the character
    is unnamed or the actor's self."""
    # What a credit puts in brackets, and the roles that name nobody.
    name = F.trim(F.regexp_replace(F.coalesce(character, F.lit("")), r"\([^)]*\)|\[[^\]]*\]", " "))
    self_role = name.rlike(r"(?i)^(him|her|them)sel(f|ves)\b|^self\b|^narrator\b|^various\b")
    use = F.when((name == "") | self_role, F.coalesce(actor, F.lit(""))).otherwise(name)
    return F.array_except(F.regexp_extract_all(fold(F.lower(use)), F.lit(r"([a-z]{3,})"), 1), F.array(*[F.lit(w) for w in stopwords]))


def sql_literal(value: str) -> str:
    return "'" + re.sub("'", "''", value) + "'"
