"""Requests as a page makes them: parameters in, one DataFrame out."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialex.functions.lexicon import PROFANITY, STOPWORDS
from dialex.functions.predicates import in_languages
from dialex.functions.text import sql_literal
from dialex.operators import boards, corpus, pages, signatures, slices, trends

MOST_WORDS, MOST_ENTITIES = 4, 3


def asked_words(query: str) -> list[str]:
    """The words of a request, lower case, each once, four at most."""
    return list(dict.fromkeys(w.strip().lower() for w in query.split(",") if w.strip()))[:MOST_WORDS]


def asked_languages(param: str | None, stored: list[str], known: list[str]) -> list[str]:
    """Languages of the request, else those stored; unknown codes don't count."""
    codes = stored if param is None else param.split(",")
    return [c for c in dict.fromkeys(codes) if c in known]


def asked_rating(param: str | None) -> str | None:
    return param if param in ("g", "pg", "pg13", "r") else None


def is_per_film(params: dict[str, str]) -> bool:
    return params.get("per") == "film"


def trends_link(words: list[str], per_film: bool = False, rating: str | None = None) -> str:
    """The address of a chart of some words; what is as usual isn't in it. `asked_words` and its like take it apart."""
    link = "/trends?w=" + quote(",".join(words), safe="!'()*-._~")
    return link + ("&per=film" if per_film else "") + (f"&rating={rating}" if rating else "")


@dataclass
class Engine:
    """The tables of a corpus, and the requests over them. Tables are DataFrames, so a request over a slice is the same
    plan over fewer films."""

    films: DataFrame
    words: DataFrame
    meta: DataFrame
    ratings: DataFrame | None = None
    stopwords: tuple[str, ...] = STOPWORDS
    profanity: tuple[str, ...] = PROFANITY
    floor: int = 20
    _kept: dict = field(default_factory=dict, repr=False)

    def slice(self, langs: list[str] | None = None, rating: str | None = None) -> Engine:
        films = self.films.where(in_languages(F.col("lang"), langs or []))
        if rating:
            films = slices.rating_slice(films, self.words, self.ratings, rating)["films"]
        return Engine(films, corpus.words_of(self.words, films), self.meta, self.ratings, self.stopwords, self.profanity, self.floor)

    @property
    def word_year(self) -> DataFrame:
        return self._kept.setdefault("word_year", corpus.word_year(self.words, self.films, self.floor))

    def leaderboard(self, years: tuple[int, int] | None = None, genre: str | None = None, langs: list[str] | None = None, top: int = 400) -> DataFrame:
        where = in_languages(F.col("lang"), langs or [])
        if years:
            where = where & F.col("year").between(*years)
        if genre:
            where = where & F.array_contains("genres", genre)
        return boards.filtered_leaderboard(self.words, self.films, self.meta, where, top)

    def trends(self, query: str, per_film: bool = False, min_total: int = 100_000) -> DataFrame:
        words = asked_words(query)
        if per_film:
            return trends.per_film_series(self.word_year, corpus.year_films(self.films), words)
        return trends.series(self.word_year, corpus.year_totals(self.word_year), words, min_total)

    @property
    def dictionary(self) -> DataFrame:
        """Words of the corpus by how often they are said; kept, as every film's page is held against it."""
        if "dictionary" not in self._kept:
            self._kept["dictionary"] = corpus.dictionary(self.words).persist()
        return self._kept["dictionary"]

    def film(self, film_id) -> DataFrame:
        own = self.words.where(F.col("film_id") == film_id)
        return pages.film_page(own, self.dictionary, self.meta, self.stopwords)

    def films_since(self, year: int) -> DataFrame:
        return trends.films_since(corpus.year_films(self.films), year)

    def search(self, query: str, top: int = 8) -> DataFrame:
        return pages.title_search(self.films, query, top)

    def entity(self, key: str) -> DataFrame:
        return pages.entity_films(self.films, key)

    def compare(self, keys: list[str], min_count: int = 30, min_ratio: float = 2.5) -> DataFrame:
        """Up to three of film ids, d:1980 and g:Crime, head to head. Only the films of what is compared are counted."""
        asked = [(k, *k.partition(":")[::2]) for k in keys[:MOST_ENTITIES]]
        kinds = {"d": "decades", "g": "genres"}
        entities = [(k, kinds[kind], value) for k, kind, value in asked if kind in kinds]
        ids = [k for k, kind, _ in asked if kind not in kinds]
        name = F.lit(None).cast("string")
        for k, kind, value in entities:
            name = F.when((F.col("kind") == kind) & (F.col("key") == value), F.lit(k)).otherwise(name)
        film = F.col("film_id").cast("string")
        lists = self.words.where(film.isin(ids)).select(film.alias("key"), "word", "count")
        totals = self.films.where(film.isin(ids)).select(film.alias("key"), "total_words")
        if entities:
            counts, sizes = signatures.entity_counts(self.words, self.films, name.isNotNull())
            top = signatures.top_words_of(counts, sizes).select(name.alias("key"), "word", "count")
            figures = signatures.figures_of(counts, sizes, self.profanity).select(name.alias("key"), "total_words")
            lists, totals = lists.unionByName(top), totals.unionByName(figures)
        return signatures.head_to_head(lists, totals, min_count, min_ratio)

    def sql(self, statement: str, **parameters) -> DataFrame:
        """SQL over the tables movies, words, word_year and word_meta; :names are parameters."""
        for name, df in (("movies", self.films), ("words", self.words), ("word_year", self.word_year), ("word_meta", self.meta)):
            df.createOrReplaceTempView(name)
        return self.films.sparkSession.sql(statement, args=parameters or None)


__all__ = ["Engine", "asked_languages", "asked_rating", "asked_words", "sql_literal"]


def day_index(size: int, seconds: float) -> int:
    """The item of the day among `size`, from seconds since 1970: another one every day."""
    return int(seconds // 86_400) % size


def step_featured(index: int, direction: int, size: int) -> int:
    """The next (1) or previous (-1) item, going on at the other end."""
    return (index + direction) % size


def toggle_pin(pins: list[str], word: str) -> list[str]:
    """The pinned words with `word` added, or without it if it was there."""
    return [p for p in pins if p != word] if word in pins else [*pins, word]
