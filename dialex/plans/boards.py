"""Queries: counts, films, leaderboards, boards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialex.functions.predicates import solid_word, word_filter, word_kind
from dialex.operators import boards, corpus, slices
from dialex.plans.catalog import query
from dialex.plans.corpus import Corpus, stop_sql

STOP = stop_sql()
SWEAR = stop_sql(Corpus.profanity)


@query("token_counts", "SELECT * FROM counts")
def token_counts(c: Corpus) -> DataFrame:
    return c.counts


@query("film_stats", "SELECT film_id, total_words, unique_words, words_per_minute FROM all_films")
def film_stats(c: Corpus) -> DataFrame:
    return corpus.film_stats(c.counts, c.curated)


_FILM = "film_id, title, year, runtime_minutes, genres[1] AS genre, lang, votes, total_words, unique_words, words_per_minute"


def _flat(films: DataFrame) -> DataFrame:
    return films.select("film_id", "title", "year", "runtime_minutes", F.col("genres")[0].alias("genre"), "lang", "votes", "total_words", "unique_words", "words_per_minute")


@query("movies_ok", f"SELECT {_FILM} FROM films")
def movies_ok(c: Corpus) -> DataFrame:
    return _flat(c.films)


@query("movies_flagged", f"SELECT {_FILM}, quality FROM all_films WHERE quality <> 'ok'")
def movies_flagged(c: Corpus) -> DataFrame:
    low = corpus.flagged_films(c.all_films)
    return _flat(low).join(low.select("film_id", "quality"), "film_id")


@query("movies_english", f"SELECT {_FILM} FROM films WHERE lang = 'en'")
def movies_english(c: Corpus) -> DataFrame:
    return _flat(c.films.where("lang = 'en'"))


@query("movies_index", "SELECT film_id, title, year, lang, votes, CASE WHEN quality <> 'ok' THEN 'low' END AS q FROM all_films")
def movies_index(c: Corpus) -> DataFrame:
    return corpus.films_index(c.all_films)


@query("corpus_dictionary", "SELECT word, count FROM dict")
def corpus_dictionary(c: Corpus) -> DataFrame:
    return c.dictionary


@query("document_frequency", "SELECT word, films FROM dict")
def document_frequency(c: Corpus) -> DataFrame:
    return corpus.document_frequency(c.words)


@query("word_meta", "SELECT * FROM meta")
def word_meta(c: Corpus) -> DataFrame:
    return c.meta


@query("leaderboard", f"SELECT word, count, films FROM dict WHERE word NOT IN {STOP} ORDER BY count DESC, word LIMIT 1000")
def leaderboard(c: Corpus) -> DataFrame:
    return boards.leaderboard(c.words, c.stopwords)


@query("leaderboard_stopwords", f"SELECT word, count, films FROM dict WHERE word IN {STOP} ORDER BY count DESC, word LIMIT 50")
def leaderboard_stopwords(c: Corpus) -> DataFrame:
    return boards.leaderboard(c.words, c.stopwords, 50, only_stopwords=True)


_FILTERED = """, f AS (SELECT film_id FROM films WHERE year BETWEEN 1950 AND 1999 AND lang IN ('en', 'fr') AND list_contains(genres, 'src1')),
b AS (SELECT word, sum(count)::BIGINT AS count, count(*)::BIGINT AS films FROM words WHERE film_id IN (SELECT film_id FROM f) GROUP BY word ORDER BY 2 DESC, 1 LIMIT 400),
m AS (SELECT b.word, b.count, b.films, zipf, classes, pos, dist FROM b LEFT JOIN meta USING (word))"""


def _filtered(c: Corpus) -> DataFrame:
    where = F.col("year").between(1950, 1999) & F.col("lang").isin("en", "fr") & F.array_contains("genres", "src1")
    return boards.filtered_leaderboard(c.words, c.films, c.meta, where)


@query("leaderboard_filtered", _FILTERED + " SELECT * FROM m")
def leaderboard_filtered(c: Corpus) -> DataFrame:
    return _filtered(c)


@query("leaderboard_movieish", _FILTERED + " SELECT *, count * greatest(coalesce(dist, 0), 0) AS score FROM m ORDER BY score DESC, word LIMIT 50")
def leaderboard_movieish(c: Corpus) -> DataFrame:
    return boards.movieish(_filtered(c))


@query("word_filter", f"SELECT word, count, pos FROM dict JOIN meta USING (word) WHERE zipf < 5 AND word NOT IN {STOP} AND pos IN ('n', 'v') AND pos NOT IN ('v') ORDER BY count DESC, word LIMIT 500")
def filtered_words(c: Corpus) -> DataFrame:
    rows = c.dictionary.join(c.meta, "word")
    kind = word_kind(F.col("pos"), F.col("classes"))
    return rows.where(word_filter(F.col("word"), F.col("zipf"), kind, c.stopwords, include="nv", exclude="v")).select("word", "count", "pos").orderBy(F.desc("count"), "word").limit(500)


@query("adjectives_card", f"SELECT word, count FROM dict JOIN meta USING (word) WHERE pos = 'a' AND zipf < 5 AND word NOT IN {STOP} ORDER BY count DESC, word LIMIT 5")
def adjectives_card(c: Corpus) -> DataFrame:
    rows = boards.leaderboard(c.words, c.stopwords, None).join(c.meta, "word")
    return rows.where(word_filter(F.col("word"), F.col("zipf"), F.col("pos"), c.stopwords, include="a")).select("word", "count").orderBy(F.desc("count"), "word").limit(5)


@query("ubiquity", f"SELECT word, films, round(films / (SELECT count(*) FROM films)::DOUBLE, 4) AS share FROM dict WHERE word NOT IN {STOP} ORDER BY films DESC, word LIMIT 50")
def ubiquity(c: Corpus) -> DataFrame:
    return boards.ubiquity(c.words, c.films, c.stopwords)


@query(
    "one_film_wonders",
    """, t AS (SELECT word, sum(count)::BIGINT AS total, max(count)::BIGINT AS top, count(DISTINCT film_id) AS films FROM words GROUP BY word)
SELECT t.word, w.film_id, m.title, m.year, w.count, t.total, round(w.count / t.total::DOUBLE, 2) AS share
FROM t JOIN words w ON w.word = t.word AND w.count = t.top JOIN films m USING (film_id)
WHERE t.top >= 10 AND t.films >= 3 AND t.top >= (t.total - t.top) * 0.5 AND length(t.word) >= 4 AND regexp_matches(t.word, '[aeiouy]')
QUALIFY row_number() OVER (PARTITION BY t.word ORDER BY w.film_id) = 1 ORDER BY w.count DESC, t.word LIMIT 50""",
)
def one_film_wonders(c: Corpus) -> DataFrame:
    return boards.one_film_wonders(c.words, c.films, 10, 3, 0.5)


_SHIFTS = """, r AS (SELECT (year // 10) * 10 AS decade, word, sum(count)::BIGINT AS c FROM word_year WHERE year BETWEEN 1930 AND 2029 GROUP BY ALL),
t AS (SELECT decade, sum(c) AS t FROM r GROUP BY decade),
k AS (SELECT word FROM r GROUP BY word HAVING sum(c) >= 200 AND count(*) >= 6 AND word IN (SELECT word FROM meta WHERE pos IN ('n', 'v', 'a', 'r') OR zipf >= 4)),
q AS (SELECT word, decade, c / t.t::DOUBLE * 1e6 AS rate FROM r JOIN t USING (decade) WHERE word IN (SELECT word FROM k)),
s AS (SELECT word, round(log2(((sum(rate) FILTER (decade IN (2010, 2020)) IS NOT NULL)::INT * coalesce(sum(rate) FILTER (decade IN (2010, 2020)), 0) / 2 + 0.1)
             / (coalesce(sum(rate) FILTER (decade IN (1930, 1940)), 0) / 2 + 0.1)), 2) AS score FROM q GROUP BY word)"""


def _shifts(c: Corpus) -> DataFrame:
    good = c.meta.where(solid_word(F.col("pos"), F.col("zipf")))
    return boards.shifts(c.word_year, 200, 6, good)


@query("risers", _SHIFTS + " SELECT * FROM (SELECT * FROM s ORDER BY score DESC, word LIMIT 50) WHERE score > 0")
def risers(c: Corpus) -> DataFrame:
    return boards.risers(_shifts(c)).drop("rates")


@query("fallers", _SHIFTS + " SELECT * FROM (SELECT * FROM s ORDER BY score, word DESC LIMIT 50) WHERE score < 0")
def fallers(c: Corpus) -> DataFrame:
    return boards.fallers(_shifts(c)).drop("rates")


_BOARD = "SELECT film_id, title, year, {value} AS value FROM {rows} ORDER BY {order}, film_id LIMIT 20"
_LONG = "(SELECT * FROM films WHERE votes >= 1000 AND total_words >= 200)"
_SUPERLATIVES = {
    "chattiest": _BOARD.format(value="round(words_per_minute, 1)", rows=f"(SELECT * FROM {_LONG} WHERE runtime_minutes >= 60 AND words_per_minute < 250)", order="words_per_minute DESC"),
    "vocabulary": _BOARD.format(value="unique_words", rows="(SELECT * FROM films WHERE votes >= 1000)", order="unique_words DESC"),
    "repetitive": _BOARD.format(value="round(unique_words / total_words::DOUBLE * 100, 1)", rows=_LONG, order="unique_words / total_words::DOUBLE"),
    "sweariest": _BOARD.format(value="per1k", rows=f"(SELECT f.*, round(n / total_words::DOUBLE * 1000, 1) AS per1k FROM {_LONG} f JOIN (SELECT film_id, sum(count) AS n FROM words WHERE word IN {SWEAR} GROUP BY film_id) USING (film_id))", order="per1k DESC"),
}


def _superlative(name: str) -> None:
    @query(f"superlatives_{name}", _SUPERLATIVES[name])
    def board(c: Corpus) -> DataFrame:
        return boards.superlatives(c.films, c.words, c.profanity, min_words=200)[name]


for _name in _SUPERLATIVES:
    _superlative(_name)


@query("swears_per_film", f"SELECT film_id, sum(count)::BIGINT AS swears FROM words WHERE word IN {SWEAR} GROUP BY film_id")
def swears_per_film(c: Corpus) -> DataFrame:
    return boards.swears_per_film(c.words, None, c.profanity)


@query("hero_stats", "SELECT count(*)::BIGINT AS films, sum(total_words)::BIGINT AS words FROM films")
def hero_stats(c: Corpus) -> DataFrame:
    return corpus.hero_stats(c.films)


@query("word_page_two", f"SELECT word, count, films FROM (SELECT *, row_number() OVER (ORDER BY count DESC, word) AS n FROM dict WHERE word NOT IN {STOP}) WHERE n > 50 AND n <= 100")
def word_page_two(c: Corpus) -> DataFrame:
    rows = boards.leaderboard(c.words, c.stopwords, None)
    return boards.page(rows, [F.desc("count"), F.asc("word")], 2)


# --- merges of two languages' lists ---

_LANG_BOARD = "SELECT word, sum(count)::BIGINT AS count, count(*)::BIGINT AS films FROM words JOIN films USING (film_id) WHERE lang = '{lang}' GROUP BY word"


def _lang_words(c: Corpus, lang: str) -> DataFrame:
    return corpus.words_of(c.words, c.films.where(F.col("lang") == lang))


@query(
    "merge_leaderboard",
    f""", a AS ({_LANG_BOARD.format(lang="en")} ORDER BY 2 DESC, 1 LIMIT 300), b AS ({_LANG_BOARD.format(lang="fr")} ORDER BY 2 DESC, 1 LIMIT 300)
SELECT word, sum(count)::BIGINT AS count, sum(films)::BIGINT AS films FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY word ORDER BY 2 DESC, 1 LIMIT 400""",
)
def merge_leaderboard(c: Corpus) -> DataFrame:
    return slices.merge_words([boards.leaderboard(_lang_words(c, lang), (), 300) for lang in ("en", "fr")], 400)


@query(
    "merge_ubiquity",
    f""", p AS (
  SELECT * FROM (SELECT word, films, round(films / (SELECT count(*) FROM films WHERE lang = 'en')::DOUBLE, 4) AS share FROM ({_LANG_BOARD.format(lang="en")}) ORDER BY films DESC, word LIMIT 60)
  UNION ALL
  SELECT * FROM (SELECT word, films, round(films / (SELECT count(*) FROM films WHERE lang = 'fr')::DOUBLE, 4) AS share FROM ({_LANG_BOARD.format(lang="fr")}) ORDER BY films DESC, word LIMIT 60))
SELECT word, films, films / n AS share FROM (SELECT word, sum(films)::BIGINT AS films, sum(round(films / share)) AS n FROM p GROUP BY word)""",
)
def merge_ubiquity(c: Corpus) -> DataFrame:
    return slices.merge_ubiquity([boards.ubiquity(_lang_words(c, lang), c.films.where(F.col("lang") == lang), (), 60) for lang in ("en", "fr")])


@query(
    "merge_superlatives",
    """, p AS (SELECT * FROM (SELECT 0 AS p, film_id, title, year, unique_words AS value FROM films WHERE lang = 'en' AND votes >= 1000 ORDER BY unique_words DESC, film_id LIMIT 20)
 UNION ALL SELECT * FROM (SELECT 1, film_id, title, year, unique_words FROM films WHERE lang = 'de' AND votes >= 1000 ORDER BY unique_words DESC, film_id LIMIT 20))
SELECT film_id, title, year, value FROM p ORDER BY value DESC, p, film_id LIMIT 20""",
)
def merge_superlatives(c: Corpus) -> DataFrame:
    return slices.merge_superlatives([boards.superlatives(c.films.where(F.col("lang") == lang), c.words, ())["vocabulary"] for lang in ("en", "de")])


@query(
    "merge_wonders",
    """, t AS (SELECT lang, word, sum(count)::BIGINT AS total, max(count)::BIGINT AS top, count(*) AS films, min(film_id) FILTER (rn = 1) AS film_id
  FROM (SELECT w.*, lang, row_number() OVER (PARTITION BY lang, word ORDER BY count DESC, w.film_id) AS rn FROM words w JOIN films USING (film_id) WHERE lang IN ('en', 'fr')) GROUP BY lang, word),
k AS (SELECT * FROM t WHERE top >= 5 AND films >= 2 AND top >= (total - top) * 0.5 AND length(word) >= 4 AND regexp_matches(word, '[aeiouy]')
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY top DESC, word) <= 50)
SELECT word, k.film_id, title, year, top AS count, total, round(top / total::DOUBLE, 2) AS share FROM k JOIN films USING (film_id)
WHERE word IN (SELECT word FROM k GROUP BY word HAVING count(*) = 1) ORDER BY share DESC, CASE k.lang WHEN 'en' THEN 0 ELSE 1 END, word LIMIT 50""",
)
def merge_wonders(c: Corpus) -> DataFrame:
    parts = [(c.films.where(F.col("lang") == lang)) for lang in ("en", "fr")]
    return slices.merge_wonders([boards.one_film_wonders(corpus.words_of(c.words, f), f, 5, 2, 0.5) for f in parts])
