"""Queries: distinctive words, comparisons, pages, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialex.functions import text
from dialex.operators import boards, corpus, pages, signatures, slices
from dialex.plans.boards import STOP, SWEAR
from dialex.plans.catalog import query
from dialex.plans.corpus import Corpus
from dialex.sources.scratch import written


def z_sql(counts: str, key: str, corpus_sql: str, min_count: int, extra: str = "") -> str:
    """SQL of log-odds scores over counts(key, word, count) and a corpus(word, count)."""
    return f"""SELECT {key}, word, count, (ln((count + pr) / (n + 100 - count - pr)) - ln((yc + pr) / (nc + 100 - yc - pr))) / sqrt(1 / (count + pr) + 1 / (yc + pr)) AS z{extra}
FROM (SELECT c.*, n.n, k.count AS yc, nc, 100.0::DOUBLE * k.count / nc AS pr FROM {counts} c JOIN (SELECT {key}, sum(count)::DOUBLE AS n FROM {counts} GROUP BY {key}) n USING ({key})
      JOIN {corpus_sql} k USING (word), (SELECT sum(count)::DOUBLE AS nc FROM {corpus_sql}) WHERE c.count >= {min_count})
WHERE n + 100 - count - pr > 0 AND nc + 100 - yc - pr > 0"""


@query("log_odds_film", ", z AS (" + z_sql("words", "film_id", "dict", 3) + ") SELECT film_id, word, count, coalesce(nullif(round(z, 6), 0), 0)::DOUBLE AS z FROM z")
def log_odds_film(c: Corpus) -> DataFrame:
    return signatures.log_odds(c.words, c.dictionary).withColumn("z", F.round("z", 6))


_MEMBERS = """, mem AS (SELECT 'decades' AS kind, ((year // 10) * 10)::VARCHAR AS key, film_id FROM films
  UNION ALL SELECT 'genres', unnest(list_distinct(genres)), film_id FROM films),
sz AS (SELECT kind, key, count(*)::BIGINT AS movie_count FROM mem GROUP BY ALL),
ec AS (SELECT kind, key, word, sum(count)::BIGINT AS count, count(*)::BIGINT AS films FROM words JOIN mem USING (film_id) GROUP BY ALL),
ek AS (SELECT kind || chr(9) || key AS entity, word, count FROM ec JOIN sz USING (kind, key) WHERE films >= least(3, movie_count))"""
_SIGNATURES = (
    _MEMBERS
    + f""", tp AS (SELECT entity, 'top' AS list, row_number() OVER (PARTITION BY entity ORDER BY count DESC, word)::INT AS rank, word, count, NULL::DOUBLE AS z FROM ek WHERE word NOT IN {STOP} QUALIFY rank <= 100),
zs AS ({z_sql("ek", "entity", "dict", 20)}),
sg AS (SELECT entity, 'signature' AS list, row_number() OVER (PARTITION BY entity ORDER BY z DESC, word)::INT AS rank, word, count, coalesce(nullif(round(z, 2), 0), 0)::DOUBLE AS z FROM zs QUALIFY rank <= 100),
al AS (SELECT * FROM tp UNION ALL SELECT * FROM sg)
SELECT string_split(entity, chr(9))[1] AS kind, string_split(entity, chr(9))[2] AS key, list, rank, word, count, z FROM al"""
)


@query("signature_decades", _SIGNATURES + " WHERE entity LIKE 'decades%'")
def signature_decades(c: Corpus) -> DataFrame:
    return signatures.signatures_of(c.entity_counts, c.entity_sizes, c.dictionary, c.stopwords).where("kind = 'decades'")


@query("signature_genres", _SIGNATURES + " WHERE entity LIKE 'genres%'")
def signature_genres(c: Corpus) -> DataFrame:
    return signatures.signatures_of(c.entity_counts, c.entity_sizes, c.dictionary, c.stopwords).where("kind = 'genres'")


@query(
    "signatures_ext",
    _MEMBERS
    + f""" SELECT kind, key, any_value(movie_count) AS movie_count, coalesce(sum(count) FILTER (films >= least(3, movie_count)), 0)::BIGINT AS total_words, count(*)::BIGINT AS unique_words,
round(coalesce(sum(count) FILTER (word IN {SWEAR}), 0) / sum(count)::DOUBLE * 1000, 2) AS swears_per_1k FROM ec JOIN sz USING (kind, key) GROUP BY kind, key""",
)
def signatures_ext(c: Corpus) -> DataFrame:
    return signatures.figures_of(c.entity_counts, c.entity_sizes, c.profanity)


@query("signature_top_words", _MEMBERS + " SELECT kind, key, row_number() OVER (PARTITION BY kind, key ORDER BY count DESC, word)::INT AS rank, word, count FROM ec JOIN sz USING (kind, key) WHERE films >= least(3, movie_count) QUALIFY rank <= 2000")
def signature_top_words(c: Corpus) -> DataFrame:
    return signatures.top_words_of(c.entity_counts, c.entity_sizes)


@query("entity_index", _MEMBERS + " SELECT kind, key, movie_count, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'decades' THEN key END, movie_count DESC, key)::INT AS place FROM sz")
def entity_index(c: Corpus) -> DataFrame:
    return pages.entity_index(signatures.memberships(c.films).groupBy("kind", "key").agg(F.count("*").alias("movie_count")))


@query("genre_keys", "SELECT DISTINCT unnest(genres) AS genre FROM films")
def genre_keys(c: Corpus) -> DataFrame:
    return c.films.select(F.explode("genres").alias("genre")).distinct()


_H2H = (
    _MEMBERS
    + """, tw AS (SELECT key, word, count FROM ec JOIN sz USING (kind, key) WHERE kind = 'decades' AND films >= least(3, movie_count) AND key IN ('1950', '1980', '2010')
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY count DESC, word) <= 2000),
tt AS (SELECT key, sum(count)::BIGINT AS total FROM tw GROUP BY key), ra AS (SELECT key, word, count, count / total::DOUBLE * 1e6 AS rate FROM tw JOIN tt USING (key)),
fl AS (SELECT key, min(rate) AS floor FROM ra GROUP BY key),
w AS (SELECT a.key, a.word, min(a.rate / greatest(coalesce(b.rate, fl.floor), 0.01)) AS worst FROM ra a JOIN fl ON fl.key <> a.key LEFT JOIN ra b ON b.key = fl.key AND b.word = a.word WHERE a.count >= 5 GROUP BY ALL)"""
)


@query("head_to_head", _H2H + " SELECT key, word, round(worst, 1) AS ratio FROM w WHERE worst >= 1.5 QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(worst, 1) DESC, word) <= 10")
def head_to_head(c: Corpus) -> DataFrame:
    lists = signatures.top_words_of(c.entity_counts, c.entity_sizes).where(F.col("kind") == "decades").where(F.col("key").isin("1950", "1980", "2010"))
    totals = lists.groupBy("key").agg(F.sum("count").alias("total_words"))
    return signatures.head_to_head(lists.select("key", "word", "count"), totals, 5, 1.5)


@query(
    "shared_signature",
    _SIGNATURES.split("SELECT string_split")[0]
    + """, s AS (SELECT string_split(entity, chr(9))[2] AS key, rank, word FROM tp WHERE entity LIKE 'decades%')
SELECT rank, word FROM s WHERE key = '1950' AND word IN (SELECT word FROM s WHERE key = '1980') AND word IN (SELECT word FROM s WHERE key = '2010') ORDER BY rank LIMIT 15""",
)
def shared_signature(c: Corpus) -> DataFrame:
    lists = signatures.signatures_of(c.entity_counts, c.entity_sizes, c.dictionary, c.stopwords).where("kind = 'decades' AND list = 'top'")
    return signatures.shared_words(lists, ["1950", "1980", "2010"])


@query(
    "merge_signatures",
    _MEMBERS
    + f""", pt AS (SELECT lang, key, word, sum(count)::BIGINT AS count FROM words JOIN mem USING (film_id) JOIN films USING (film_id) WHERE kind = 'decades' AND lang IN ('en', 'fr') GROUP BY lang, key, word
  QUALIFY row_number() OVER (PARTITION BY lang, key ORDER BY sum(count) DESC, word) <= 100),
su AS (SELECT key, word, sum(count)::BIGINT AS count FROM pt GROUP BY ALL), co AS (SELECT word, sum(count)::BIGINT AS count FROM pt GROUP BY word),
zz AS ({z_sql("su", "key", "co", 20)})
SELECT key, word, count, coalesce(nullif(round(z, 2), 0), 0)::DOUBLE AS z, row_number() OVER (PARTITION BY key ORDER BY z DESC, word)::INT AS rank FROM zz QUALIFY rank <= 100""",
)
def merge_signatures(c: Corpus) -> DataFrame:
    def part(lang: str) -> DataFrame:
        counts, _ = signatures.entity_counts(c.words, c.films.where(F.col("lang") == lang))
        return written(boards_top(counts.where("kind = 'decades'")), "top-lists")  # the merge reads each list four times

    return slices.merge_signatures([part("en"), part("fr")])


def boards_top(counts: DataFrame, top: int = 100) -> DataFrame:
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("count"), "word"))).where(F.col("_r") <= top).select("key", "word", "count")


_LISTS = f""", o AS ({z_sql("words", "film_id", "dict", 3)}),
pl AS (SELECT film_id, 'top' AS list, row_number() OVER (PARTITION BY film_id ORDER BY count DESC, word)::INT AS rank, word, count, NULL::DOUBLE AS z FROM words WHERE word NOT IN {STOP} QUALIFY rank <= 200
  UNION ALL SELECT film_id, 'top_all', row_number() OVER (PARTITION BY film_id ORDER BY count DESC, word)::INT AS rank, word, count, NULL FROM words QUALIFY rank <= 50
  UNION ALL SELECT film_id, 'distinctive', row_number() OVER (PARTITION BY film_id ORDER BY z DESC, word)::INT AS rank, word, count, coalesce(nullif(round(z, 2), 0), 0)::DOUBLE FROM o QUALIFY rank <= 50)"""
_PAGE = f"""{_LISTS}
SELECT pl.*, coalesce(zipf, 0.0)::DOUBLE AS zipf, coalesce(classes, 'x') AS classes, coalesce(pos, 'x') AS pos FROM pl LEFT JOIN meta USING (word)"""


@query("film_page", _PAGE)
def film_page(c: Corpus) -> DataFrame:
    return pages.film_page(c.words, c.dictionary, c.meta, c.stopwords)


@query(
    "film_words",
    """SELECT w.film_id, w.word, w.count, coalesce(films, 0)::BIGINT + own AS films FROM (SELECT film_id, word, count, 0 AS own FROM words
UNION ALL SELECT film_id, word, count, 1 FROM counts WHERE film_id IN (SELECT film_id FROM all_films WHERE quality <> 'ok')) w LEFT JOIN dict USING (word)""",
)
def film_words(c: Corpus) -> DataFrame:
    return pages.film_words(c.words, c.flagged_words)


@query(
    "merged_word_list",
    f""", a AS (SELECT word, count, row_number() OVER (ORDER BY count DESC, word) AS r FROM words WHERE film_id = 10 AND word NOT IN {STOP} QUALIFY r <= 200),
b AS (SELECT word, count, row_number() OVER (ORDER BY count DESC, word) AS r FROM words WHERE film_id = 10 QUALIFY r <= 50),
u AS (SELECT word, count, 0 AS p, r FROM a UNION ALL SELECT word, count, 1, r FROM b)
SELECT row_number() OVER (ORDER BY min(p * 100000 + r))::INT AS rank, word, arg_max(count, p) AS count FROM u GROUP BY word""",
)
def merged_word_list(c: Corpus) -> DataFrame:
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("count"), "word")
    own = c.words.where("film_id = 10")
    top = lambda rows, k: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("rank", "word", "count")
    return slices.merge_word_lists(top(own.where(~F.col("word").isin(*c.stopwords)), 200), top(own, 50))


@query("title_search", "SELECT film_id, title, year, votes FROM films WHERE lower(title) LIKE '%film 1%' ORDER BY votes DESC, film_id LIMIT 8")
def title_search(c: Corpus) -> DataFrame:
    return pages.title_search(c.films, " Film 1").select("film_id", "title", "year", "votes")


@query("entity_films", "SELECT film_id, title, year, votes FROM films WHERE year // 10 = 198 ORDER BY votes DESC, film_id LIMIT 12")
def entity_films(c: Corpus) -> DataFrame:
    return pages.entity_films(c.films, "d:1980").select("film_id", "title", "year", "votes")


@query("genre_films", "SELECT film_id, title, year, votes FROM films WHERE list_contains(genres, 'src4') ORDER BY votes DESC, film_id LIMIT 12")
def genre_films(c: Corpus) -> DataFrame:
    return pages.entity_films(c.films, "g:src4").select("film_id", "title", "year", "votes")


@query("random_shelf", "SELECT film_id, title, votes FROM (SELECT * FROM films ORDER BY votes DESC, film_id LIMIT 60) ORDER BY md5('7-' || film_id), film_id LIMIT 8")
def random_shelf(c: Corpus) -> DataFrame:
    return pages.random_shelf(c.films, 7).select("film_id", "title", "votes")


@query("rare_sort", f"SELECT word, count, films FROM dict WHERE word NOT IN {STOP} ORDER BY films, count DESC, word LIMIT 50")
def rare_sort(c: Corpus) -> DataFrame:
    rows = boards.leaderboard(c.words, c.stopwords, None)
    return rows.orderBy(*pages.sort_words(rows, "rare")).limit(50)


@query("only_in_film", "SELECT word, w.count, films FROM words w JOIN dict d USING (word) WHERE film_id = 9 AND films = 1 AND w.count >= 2 ORDER BY w.count DESC, word LIMIT 10".replace("w JOIN dict d USING (word)", "w JOIN (SELECT word, films FROM dict) d USING (word)"))
def only_in_film(c: Corpus) -> DataFrame:
    rows = pages.film_words(c.words, c.flagged_words).where("film_id = 9").select("word", "count", "films")
    return pages.only_in_film(rows)


@query("find_words", "SELECT word, count FROM dict WHERE contains(word, 'ther')")
def find_words(c: Corpus) -> DataFrame:
    return pages.find_words(c.dictionary, " Ther ")


_THRICE = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")


@query("stretched_variants", f"SELECT word, array_to_string(list_filter(string_split(word, ''), lambda x, i: i = 1 OR x <> word[i - 1] OR x = chr(39)), '') AS base FROM dict WHERE regexp_matches(word, '{_THRICE}')")
def stretched_variants(c: Corpus) -> DataFrame:
    return pages.stretched(c.dictionary)


@query("word_keys", "SELECT word, url_encode(word) AS key FROM dict")
def word_keys(c: Corpus) -> DataFrame:
    return c.dictionary.select("word", text.word_key(F.col("word")).alias("key"))


@query("funnel", "SELECT (SELECT count(*) FROM documents)::BIGINT AS curated, (SELECT count(*) FROM stats)::BIGINT AS counted, (SELECT count(*) FROM films)::BIGINT AS final, (SELECT count(*) FROM all_films WHERE quality <> 'ok')::BIGINT AS flagged")
def funnel(c: Corpus) -> DataFrame:
    return corpus.funnel({"curated": c.curated, "counted": c.counts.select("film_id").distinct(), "final": c.films, "flagged": corpus.flagged_films(c.all_films)})


@query("quality_note", "SELECT film_id, quality AS tier, CASE WHEN quality = 'low' THEN 'label' ELSE '' END AS flags FROM all_films")
def quality_note(c: Corpus) -> DataFrame:
    return c.all_films.select("film_id", F.struct(F.col("quality").alias("tier"), F.array_join("quality_flags", ",").alias("flags")).alias("n")).select("film_id", "n.tier", "n.flags")


def _entries(name: str) -> str:
    """SQL of a list of a film's page as JSON."""
    entry = """'{"rank":' || rank || ',"word":"' || word || '","count":' || count || coalesce(',"z":' || z, '') || '}'"""
    return f"""',"{name}":[' || coalesce(string_agg({entry}, ',' ORDER BY rank) FILTER (WHERE list = '{name}'), '') || ']'"""


@query(
    "film_payloads",
    f"""{_LISTS},
lists AS (SELECT film_id, {" || ".join(map(_entries, ("top", "top_all", "distinctive")))} AS entries FROM pl GROUP BY film_id)
SELECT film_id::VARCHAR AS key, '{{"film_id":' || film_id || ',"title":"' || title || '","year":' || year || coalesce(',"runtime_minutes":' || runtime_minutes, '') || ',"genres":' || to_json(genres)
  || coalesce(',"votes":' || votes, '') || ',"total_words":' || total_words || ',"unique_words":' || unique_words || coalesce(',"words_per_minute":' || words_per_minute, '')
  || coalesce(',"lang":' || to_json(lang), '') || entries || '}}' AS payload
FROM films JOIN lists USING (film_id)""",
)
def film_payloads(c: Corpus) -> DataFrame:
    return pages.payloads(pages.film_lists(c.words, c.dictionary, c.stopwords), c.films)
