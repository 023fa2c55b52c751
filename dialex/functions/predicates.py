"""Filters that requests build: word kinds, languages, ratings, years."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = "nvar"


def word_kind(pos: Column, classes: Column) -> Column:
    """The dominant part of speech, else the first possible one (satellites count as adjectives), else x."""
    first = F.substring(classes, 1, 1)
    return F.coalesce(F.nullif(pos, F.lit("")), F.when(first == "s", "a").otherwise(F.nullif(first, F.lit(""))), F.lit("x"))


def word_filter(word: Column, zipf: Column, kind: Column, stopwords: Iterable[str], interesting: bool = True, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Interesting words are neither stopwords nor very common. Excluded kinds go; if any kind is included, all others go."""
    ok = F.lit(True)
    if interesting:
        ok = ok & (zipf < 5.0) & ~word.isin(*stopwords)
    if include := tuple(include):
        ok = ok & kind.isin(*include)
    if exclude := tuple(exclude):
        ok = ok & ~kind.isin(*exclude)
    return ok


def rotate_kind(state: str) -> str:
    """off, include, exclude, and off again."""
    return {"off": "include", "include": "exclude", "exclude": "off"}[state]


def in_languages(lang: Column, codes: Iterable[str]) -> Column:
    """Membership in a set of languages; zh takes in cn; no codes, no filter."""
    codes = set(codes)
    codes |= {"cn"} if "zh" in codes else set()
    return lang.isin(*sorted(codes)) if codes else F.lit(True)


def solid_word(kind: Column, zipf: Column) -> Column:
    """Words fit for boards: of a known kind, or common."""
    return kind.isin(*KINDS) | (zipf >= 4.0)


def implausible_rate(wpm: Column, year: Column, genres: Column) -> Column:
    return (wpm < 10) & (year >= 1930) & ~F.array_contains(genres, "Documentary") | (wpm > 200)


def decade(year: Column) -> Column:
    return F.floor(year / 10).cast("int") * 10
