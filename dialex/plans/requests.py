"""Queries: the cube of slices, the SQL surface, the search index, and requests of one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialex import surface
from dialex.functions.text import sql_literal
from dialex.operators import corpus, cube, lexicon, pages, selection, slices, trends
from dialex.operators.search import TrigramIndex
from dialex.plans.boards import STOP
from dialex.plans.catalog import query
from dialex.plans.corpus import Corpus
from dialex.plans.entities import _MEMBERS, z_sql
from dialex.sources.scratch import scratch


def _kept(c: Corpus, name: str, make) -> str:
    """A folder that is written once a session and folder of tables, as what reads it is asked more than once."""
    kept = c.__dict__.setdefault("_folders", {})
    if name not in kept:
        kept[name] = scratch(c.spark, name)
        make(kept[name])
    return kept[name]


def cubed(c: Corpus) -> DataFrame:
    return c.spark.read.parquet(_kept(c, "cube", lambda path: cube.write(cube.cube(c.words, c.films, c.ratings), path)))


def _slice_sql(where: str) -> str:
    """The corpus's films and words within a slice, under the names that the SQL of entities uses."""
    return f""", sf AS (SELECT * FROM films LEFT JOIN ratings USING (film_id) WHERE {where}), sw AS (SELECT * FROM words WHERE film_id IN (SELECT film_id FROM sf)),
sd AS (SELECT word, sum(count)::BIGINT AS count FROM sw GROUP BY word)"""


def _signature_sql(where: str) -> str:
    members = _MEMBERS.replace("FROM films", "FROM sf").replace("FROM words", "FROM sw")
    return f"""{_slice_sql(where)}{members},
tp AS (SELECT entity, 'top' AS list, row_number() OVER (PARTITION BY entity ORDER BY count DESC, word)::INT AS rank, word, count, NULL::DOUBLE AS z FROM ek WHERE word NOT IN {STOP} QUALIFY rank <= 100),
zs AS ({z_sql("ek", "entity", "sd", 20)}),
sg AS (SELECT entity, 'signature' AS list, row_number() OVER (PARTITION BY entity ORDER BY z DESC, word)::INT AS rank, word, count, coalesce(nullif(round(z, 2), 0), 0)::DOUBLE AS z FROM zs QUALIFY rank <= 100)
SELECT string_split(entity, chr(9))[1] AS kind, string_split(entity, chr(9))[2] AS key, list, rank, word, count, z FROM (SELECT * FROM tp UNION ALL SELECT * FROM sg)"""


_RATED = "rating IN ('r', 'nc17') AND year >= 1968"


@query("cube_signature_languages", _signature_sql("lang IN ('en', 'de')"))
def cube_signature_languages(c: Corpus) -> DataFrame:
    """Signatures of the films of two languages, from the cube alone."""
    return cube.signature(cubed(c), ["en", "de"], stopwords=c.stopwords)


@query("cube_signature_rating", _signature_sql(_RATED))
def cube_signature_rating(c: Corpus) -> DataFrame:
    return cube.signature(cubed(c), rating="r", stopwords=c.stopwords)


@query("cube_word_year", _slice_sql("lang IN ('fr', 'en')") + " SELECT word, year, sum(count)::BIGINT AS count, count(*)::BIGINT AS movie_count FROM sw JOIN sf USING (film_id) GROUP BY word, year QUALIFY sum(sum(count)) OVER (PARTITION BY word) >= 20")
def cube_word_year(c: Corpus) -> DataFrame:
    return cube.word_year(cubed(c), ["fr", "en"])


@query("cube_year_totals", _slice_sql(_RATED) + " SELECT year, coalesce(sum(n), 0)::BIGINT AS total, count(*)::BIGINT AS films FROM sf LEFT JOIN (SELECT film_id, sum(count) AS n FROM sw GROUP BY film_id) USING (film_id) GROUP BY year")
def cube_year_totals(c: Corpus) -> DataFrame:
    return cube.year_totals(cubed(c), rating="r")


@query("cube_leaderboard", _slice_sql("lang = 'de' AND year // 10 = 198") + " SELECT word, sum(count)::BIGINT AS count, count(*)::BIGINT AS films FROM sw GROUP BY word")
def cube_leaderboard(c: Corpus) -> DataFrame:
    return cube.leaderboard(cubed(c), ["de"], kind="decades", key="1980")


def published(c: Corpus, statement: str) -> DataFrame:
    surface.publish(c.spark, _kept(c, "published", lambda path: surface.write(c.films, c.words, c.meta, path)))
    return c.spark.sql(statement)


@query("sql_chattiest", "SELECT title, year, words_per_minute FROM films WHERE words_per_minute IS NOT NULL ORDER BY words_per_minute DESC, title LIMIT 10")
def sql_chattiest(c: Corpus) -> DataFrame:
    return published(c, "SELECT title, year, words_per_minute FROM movies ORDER BY words_per_minute DESC NULLS LAST, title LIMIT 10")


@query("sql_films_saying", "SELECT title, year, count FROM words JOIN films USING (film_id) WHERE word = 'hand' ORDER BY count DESC, title LIMIT 15")
def sql_films_saying(c: Corpus) -> DataFrame:
    return published(c, "SELECT m.title, m.year, w.count FROM words_by_word w JOIN movies m USING (film_id) WHERE w.word = 'hand' ORDER BY w.count DESC, m.title LIMIT 15")


@query("sql_word_over_time", "SELECT year, count, movie_count FROM word_year WHERE word = 'the'")
def sql_word_over_time(c: Corpus) -> DataFrame:
    return published(c, "SELECT year, count, movie_count FROM word_year WHERE word = 'the' ORDER BY year")


_TREND = ", yt AS (SELECT year, sum(count)::BIGINT AS total FROM words JOIN films USING (film_id) GROUP BY year), aw AS (SELECT unnest(['the', 'und', 'absent-word']) AS asked)"


@query("sql_trend", _TREND + " SELECT asked, yt.year, coalesce(count, 0)::BIGINT AS count, coalesce(movie_count, 0)::BIGINT AS films, round(coalesce(count, 0) * 1e6::DOUBLE / total, 6) AS per_million FROM aw CROSS JOIN yt LEFT JOIN word_year w ON w.word = asked AND w.year = yt.year")
def sql_trend(c: Corpus) -> DataFrame:
    """A table function beside the rows that it is called for."""
    return published(c, "SELECT asked, t.year, t.count, t.films, round(t.per_million, 6) AS per_million FROM VALUES ('the'), ('und'), ('absent-word') AS a(asked), LATERAL trend(asked) t")


@query("sql_saying", "SELECT film_id, count, round(count * 1e6::DOUBLE / total_words, 6) AS per_million FROM words JOIN films USING (film_id) WHERE word = 'hand'")
def sql_saying(c: Corpus) -> DataFrame:
    return published(c, "SELECT film_id, count, round(per_million, 6) AS per_million FROM saying(' Hand ')")


@query("sql_film", ", z AS (" + z_sql("words", "film_id", "dict", 3) + ") SELECT word, w.count, d.films, coalesce(nullif(round(z, 6), 0), 0)::DOUBLE AS z FROM words w JOIN (SELECT word, films FROM dict) d USING (word) JOIN z USING (film_id, word) WHERE film_id = 51")
def sql_film(c: Corpus) -> DataFrame:
    return published(c, "SELECT word, count, films, round(z, 6) AS z FROM film(51) WHERE z IS NOT NULL")


@query("sql_compare", """, w AS (SELECT film_id, word, count, count / sum(count) OVER (PARTITION BY film_id) AS rate FROM words WHERE film_id IN (51, 43)), f AS (SELECT film_id, min(rate) AS rate FROM w GROUP BY film_id)
SELECT a.film_id, a.word, a.count, round(a.rate / coalesce(b.rate, f.rate), 6) AS ratio FROM w a JOIN f ON f.film_id <> a.film_id LEFT JOIN w b ON b.film_id <> a.film_id AND b.word = a.word
WHERE a.count >= 3 AND a.rate > coalesce(b.rate, f.rate)""")
def sql_compare(c: Corpus) -> DataFrame:
    return published(c, "SELECT film_id, word, count, round(ratio, 6) AS ratio FROM compare(51, 43)")


@query("sql_leaderboard", "SELECT word, sum(w.count)::BIGINT AS count, count(*)::BIGINT AS films, coalesce(any_value(pos), 'x') AS kind FROM words w JOIN films USING (film_id) LEFT JOIN meta USING (word) WHERE lang = 'en' AND year BETWEEN 1960 AND 1999 GROUP BY word")
def sql_leaderboard(c: Corpus) -> DataFrame:
    return published(c, "SELECT * FROM leaderboard(language => 'en', since => 1960, until => 1999)")


_PATTERNS = ", pt AS (SELECT DISTINCT substr(word, 2, 5) AS pattern FROM dict WHERE films >= 30 AND length(word) >= 6 UNION SELECT DISTINCT lower(n_name) FROM nation)"


@query("indexed_find", _PATTERNS + " SELECT pattern, word FROM pt JOIN dict ON contains(word, pattern)")
def indexed_find(c: Corpus) -> DataFrame:
    """Words that hold parts of common words, or names of nations, by the trigram index."""
    index = TrigramIndex(c.spark, _kept(c, "index", lambda path: TrigramIndex(c.spark, path).build(_numbered(c))))
    common = c.words.groupBy("word").agg(F.count("*").alias("films")).where((F.col("films") >= 30) & (F.length("word") >= 6)).select(F.substring("word", 2, 5).alias("pattern"))
    asked = common.unionByName(c.table("nation").select(F.lower("n_name").alias("pattern"))).distinct()
    return index.find_all(asked).select("pattern", F.col("text").alias("word"))


def _numbered(c: Corpus) -> DataFrame:
    """The dictionary with numbers, which only have to differ: a hash would do but for collisions, so the place in its
    written form is taken."""
    path = scratch(c.spark, "numbered")
    c.dictionary.select(F.monotonically_increasing_id().alias("id"), F.col("word").alias("text")).write.parquet(path)
    return c.spark.read.parquet(path)


@query("indexed_titles", "SELECT film_id, title, year, votes FROM films WHERE lower(title) LIKE '%film 12%' ORDER BY votes DESC, film_id LIMIT 8")
def indexed_titles(c: Corpus) -> DataFrame:
    """A search of titles by the index; the films found are ranked as without it."""
    titles = c.films.select(F.col("film_id").alias("id"), F.col("title").alias("text"))
    index = TrigramIndex(c.spark, _kept(c, "titles", lambda path: TrigramIndex(c.spark, path).build(titles)))
    found = index.find("Film 12 ").select(F.col("id").alias("film_id"))
    return pages.title_search(c.films.join(found, "film_id", "left_semi"), "Film 12 ").select("film_id", "title", "year", "votes")


@query("filtered_index", "SELECT film_id, title, year, lang, votes FROM films WHERE lang IN ('en', 'fr')")
def filtered_index(c: Corpus) -> DataFrame:
    """The index as it is published, with low films in it, cut down to the corpus and two languages."""
    path = _kept(c, "films-index", lambda at: corpus.films_index(c.all_films).write.parquet(at))
    return corpus.filtered_index(c.spark.read.parquet(path), ["en", "fr"])


@query("films_since", "SELECT count(*)::BIGINT AS films FROM films WHERE year >= 1968")
def films_since(c: Corpus) -> DataFrame:
    return trends.films_since(corpus.year_films(c.films), 1968)


@query("top_film_rows", """SELECT aw.word, y.year, b.film_id, b.title, b.count FROM (SELECT unnest(['hand', 'nowhere-said']) AS word) aw CROSS JOIN (SELECT DISTINCT year FROM films WHERE year >= 1968) y
LEFT JOIN (SELECT word, year, film_id, title, count FROM words JOIN films USING (film_id) QUALIFY row_number() OVER (PARTITION BY word, year ORDER BY count DESC, title, film_id) = 1) b ON b.word = aw.word AND b.year = y.year""")
def top_film_rows(c: Corpus) -> DataFrame:
    """Each year's top film of two words since ratings exist; years without one have nulls."""
    asked = c.words.where("word IN ('hand', 'nowhere-said')")
    years = c.films.where(F.col("year") >= slices.RATED_SINCE).select("year")
    return trends.top_film_rows(years, trends.top_film_by_year(asked, c.films), ["hand", "nowhere-said"])


_STRONG = ("tion", "tional", "worthless")


@query("tier_recheck", f"""SELECT film_id, CASE WHEN bad THEN 'low' ELSE 'ok' END AS tier, CASE WHEN bad THEN 'anachronism' ELSE '' END AS flags FROM (
SELECT film_id, coalesce(profane > 0 AND lang = 'en' AND year < 1965 AND film_id % 9 <> 0, false) AS bad FROM films LEFT JOIN (SELECT film_id, sum(count) AS profane FROM counts WHERE word IN {_STRONG} GROUP BY film_id) USING (film_id))""")
def tier_recheck(c: Corpus) -> DataFrame:
    """Tiers checked against the full counts of chosen files, with a list of words in the strong ones' place: films of
    before 1965 that say one, and weren't verified, are low."""
    chosen = c.films.select("film_id", F.lit("ok").alias("tier"), F.array().cast("array<string>").alias("flags"))
    context = c.films.select("film_id", (F.col("lang") == "en").alias("english"), F.lit(False).alias("documentary"), (F.col("film_id") % 9 == 0).alias("verified"), "year")
    done = selection.check_full_counts(chosen, c.counts, context, "^(" + "|".join(_STRONG) + ")$")
    return done.select("film_id", "tier", F.array_join("flags", ",").alias("flags"))


_RULES = ", ".join(f"('{pos}', '{old}', '{new}', {i})" for pos, pairs in lexicon.ENDINGS.items() for i, (old, new) in enumerate(pairs))
_DISCOURSE = ("there", "hand", "und")
_LEXICON = f""", lw AS (SELECT word, count, films FROM dict WHERE length(word) >= 3),
qw AS (SELECT DISTINCT word, (length(word) % 7)::DOUBLE AS zipf FROM (SELECT unnest([word, word || 's', word || 'ed', word || 'ing', word || 'er', upper(word[1]) || word[2:]]) AS word FROM lw)),
sn AS (SELECT pos || ':' || substr(word, 1, 4) AS synset, pos, word AS lemma, n AS count FROM (SELECT word, substr('nvar', 1 + length(word) % 4, 1) AS pos, count % 7 AS n FROM lw
  UNION ALL SELECT word, substr('nvsr', 1 + (length(word) + 1) % 4, 1), films % 3 FROM lw WHERE films % 2 = 0)),
ex AS (SELECT word || 'er' AS form, 's' AS pos, word AS lemma FROM lw WHERE films % 5 = 0 UNION SELECT word || 'ed', 'v', substr(word, 1, length(word) - 1) FROM lw WHERE films % 3 = 0),
ru(pos, old, new, place) AS (VALUES {_RULES}),
kn AS (SELECT DISTINCT lower(lemma) AS form, CASE pos WHEN 's' THEN 'a' ELSE pos END AS pos FROM sn),
ir AS (SELECT DISTINCT form AS word, CASE pos WHEN 's' THEN 'a' ELSE pos END AS pos, lower(lemma) AS form FROM ex),
ap AS (SELECT word, unnest(['n', 'v', 'a', 'r']) AS pos FROM qw),
t1 AS (SELECT word, pos, substr(word, 1, length(word) - length(old)) || new AS form, place FROM (SELECT * FROM ap ANTI JOIN ir USING (word, pos)) JOIN ru USING (pos) WHERE ends_with(word, old)),
t2 AS (SELECT word, pos, substr(form, 1, length(form) - length(old)) || new AS form, ru.place FROM (SELECT DISTINCT word, pos, form FROM t1) JOIN ru USING (pos) WHERE ends_with(form, old)),
fo AS (SELECT * FROM (SELECT word, pos, word AS form, -1 AS place, 1 AS round FROM ap UNION ALL SELECT word, pos, form, dense_rank() OVER (PARTITION BY word, pos ORDER BY form), 1 FROM ir JOIN ap USING (word, pos)
  UNION ALL SELECT *, 1 FROM t1 UNION ALL SELECT *, 2 FROM t2) SEMI JOIN kn USING (form, pos)),
bf AS (SELECT word, pos, form, min(place) AS place FROM (SELECT * FROM fo QUALIFY round = min(round) OVER (PARTITION BY word, pos)) GROUP BY ALL),
ba AS (SELECT word, pos, form AS base FROM bf QUALIFY row_number() OVER (PARTITION BY word, pos ORDER BY place, form) = 1),
si AS (SELECT DISTINCT lower(lemma) AS form, CASE pos WHEN 's' THEN 'a' ELSE pos END AS pos, synset FROM sn),
sy AS (SELECT DISTINCT word, pos, synset FROM bf JOIN si USING (form, pos)),
us AS (SELECT word, pos, coalesce(sum(uses), 0) AS uses, position(pos IN 'nvar') AS p FROM sy JOIN ba USING (word, pos) LEFT JOIN (SELECT synset, lemma AS base, sum(count) AS uses FROM sn GROUP BY ALL) USING (synset, base) GROUP BY word, pos),
be AS (SELECT word, max(uses) AS uses, arg_min(pos, -uses * 10 + p) AS pos, string_agg(pos, '' ORDER BY p) AS classes FROM us GROUP BY word)
SELECT word, coalesce(classes, 'x') AS classes, CASE WHEN classes IS NULL OR word IN {_DISCOURSE} THEN 'x' WHEN uses > 0 THEN be.pos WHEN zipf >= 5 THEN 'x' ELSE be.pos END AS pos FROM qw LEFT JOIN be USING (word)"""


@query("dominant_pos", _LEXICON)
def dominant_pos(c: Corpus) -> DataFrame:
    """Parts of speech of the dictionary's words and of forms made from them, by a lexicon that is made of the
    dictionary: parts of speech by length, uses by counts."""
    known = c.words.groupBy("word").agg(F.sum("count").alias("count"), F.count("*").alias("films")).where(F.length("word") >= 3)
    w, n = F.col("word"), F.length("word")
    capital = F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    forms = F.array(w, *[F.concat(w, F.lit(e)) for e in ("s", "ed", "ing", "er")], capital)
    asked = known.select(F.explode(forms).alias("word")).distinct().withColumn("zipf", (F.length("word") % 7).cast("double"))
    sense = lambda rows, letters, at, uses: rows.select(F.substr(F.lit(letters), 1 + at % 4, F.lit(1)).alias("pos"), w.alias("lemma"), uses.alias("count"))
    senses = sense(known, "nvar", n, F.col("count") % 7).unionByName(sense(known.where("films % 2 = 0"), "nvsr", n + 1, F.col("films") % 3))
    senses = senses.withColumn("synset", F.concat("pos", F.lit(":"), F.substring("lemma", 1, 4)))
    odd = known.where("films % 5 = 0").select(F.concat(w, F.lit("er")).alias("form"), F.lit("s").alias("pos"), w.alias("lemma"))
    odd = odd.unionByName(known.where("films % 3 = 0").select(F.concat(w, F.lit("ed")).alias("form"), F.lit("v").alias("pos"), F.substr(w, F.lit(1), n - 1).alias("lemma")))
    landed = []
    for name, table in (("asked", asked), ("senses", senses), ("exceptions", odd)):
        path = scratch(c.spark, name)
        table.write.parquet(path)
        landed.append(c.spark.read.parquet(path))
    return lexicon.dominant_pos(*landed, _DISCOURSE, rounds=2)


def _split_sql(word: str, endings: tuple[str, ...] = ("n't", "'s", "'re", "'ll", "'m", "'ve", "'d")) -> str:
    tails = [f"(ends_with({word}, {sql_literal(e)}) AND NOT contains(substr({word}, 1, length({word}) - {len(e)}), chr(39)))" for e in endings]
    return f"contains(trim({word}, chr(39)), chr(39)) AND NOT ({' OR '.join(tails)})"


@query("lexicon_frequencies", f""", lf AS (SELECT DISTINCT unnest([word, word || chr(39) || 's', word || 'n' || chr(39) || 't', left(word, 2) || chr(39) || word, word || chr(39)]) AS word FROM dict)
SELECT word, CASE WHEN {_split_sql("word")} THEN 0 ELSE 1 + length(word) / 10 END::DOUBLE AS zipf FROM lf""")
def lexicon_frequencies(c: Corpus) -> DataFrame:
    """Frequencies of words and of words with apostrophes, by a table that has them all."""
    w = F.col("word")
    end = lambda e: F.concat(w, F.lit(e))
    words = c.dictionary.select(F.explode(F.array(w, end("'s"), end("n't"), F.concat(F.substring(w, 1, 2), F.lit("'"), w), end("'"))).alias("word")).distinct()
    return lexicon.frequencies(words, words.select("word", (1 + F.length("word") / 10).alias("zipf")))
