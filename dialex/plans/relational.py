"""Queries over the order tables as a second corpus: orders are films with real dates, words of part names are said as
often as the part was ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialex.operators import boards, corpus, trends
from dialex.plans.catalog import query
from dialex.plans.corpus import Corpus

_B = """WITH w AS (SELECT l_orderkey AS film_id, unnest(string_split(lower(p_name), ' ')) AS word, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey),
bw AS (SELECT film_id, word, sum(l_quantity)::BIGINT AS count FROM w GROUP BY film_id, word),
bf AS (SELECT o_orderkey AS film_id, year(o_orderdate)::INT AS year, n_name AS lang, r_name AS genre FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
"""


def b_words(c: Corpus) -> DataFrame:
    named = c.table("part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    said = c.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(named, F.col("p_partkey") == F.col("l_partkey"))
    return said.groupBy(F.col("l_orderkey").alias("film_id"), "word").agg(F.sum("l_quantity").cast("long").alias("count"))


def b_films(c: Corpus) -> DataFrame:
    nations = c.table("nation").join(c.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("lang"), F.col("r_name").alias("genre"))
    people = c.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "lang", "genre")
    return c.table("orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("film_id"), F.year("o_orderdate").alias("year"), "lang", "genre")


@query("orders_word_year", _B + "SELECT word, year, sum(count)::BIGINT AS count, count(*)::BIGINT AS movie_count FROM bw JOIN bf USING (film_id) GROUP BY word, year", base=False)
def orders_word_year(c: Corpus) -> DataFrame:
    return corpus.word_year(b_words(c), b_films(c))


@query("orders_word_year_lang", _B + "SELECT word, year, lang, sum(count)::BIGINT AS count, count(*)::BIGINT AS movie_count FROM bw JOIN bf USING (film_id) GROUP BY word, year, lang QUALIFY sum(sum(count)) OVER (PARTITION BY word, lang) >= 20", base=False)
def orders_word_year_lang(c: Corpus) -> DataFrame:
    return corpus.word_year(b_words(c), b_films(c), by=("lang",))


@query("orders_leaderboard", _B + "SELECT word, sum(count)::BIGINT AS count, count(*)::BIGINT AS films FROM bw GROUP BY word ORDER BY 2 DESC, 1 LIMIT 1000", base=False)
def orders_leaderboard(c: Corpus) -> DataFrame:
    return boards.leaderboard(b_words(c))


@query("orders_top15", _B + "SELECT word, row_number() OVER (PARTITION BY word ORDER BY count DESC, film_id)::INT AS rank, film_id, year, count FROM bw JOIN bf USING (film_id) QUALIFY rank <= 15", base=False)
def orders_top15(c: Corpus) -> DataFrame:
    films = b_films(c).select("film_id", F.lit("").alias("title"), "year", F.lit(0).alias("total_words"))
    return trends.top_films(b_words(c), films).drop("title", "total_words")


@query(
    "curated_orders",
    """SELECT 'o' || o_orderkey AS film_id, o_orderpriority AS title, year(o_orderdate)::INT AS year, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 200)::INT END AS runtime_minutes, [o_orderstatus] AS genres, 5.5::DOUBLE AS rating, n::INT AS votes
FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND n::INT >= 100""",
    base=False,
)
def curated_orders(c: Corpus) -> DataFrame:
    key = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    runtime = F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_orderkey") % 200).cast("string")).otherwise("\\N")
    kind = F.when(F.col("o_orderstatus") == "F", "movie").otherwise("short")
    basics = c.table("orders").select(key.alias("tconst"), kind.alias("titleType"), F.col("o_orderpriority").alias("primaryTitle"), F.year("o_orderdate").cast("string").alias("startYear"), runtime.alias("runtimeMinutes"), F.col("o_orderstatus").alias("genres"))
    votes = c.table("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("int").cast("string").alias("numVotes"))
    ratings = votes.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("tconst"), F.lit("5.5").alias("averageRating"), "numVotes")
    return corpus.curated(basics, ratings, 100)


@query(
    "certifications",
    """WITH e AS (SELECT l_orderkey AS film_id, (l_linenumber % 4)::INT AS type, strftime(l_shipdate, '%Y-%m-%d') AS d, CASE l_returnflag WHEN 'R' THEN 'r' WHEN 'N' THEN 'nc17' WHEN 'A' THEN 'pg13' END AS c, l_linestatus FROM lineitem)
SELECT film_id, c AS rating FROM e WHERE l_linestatus = 'O' QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY CASE type WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 9 END, d, c) = 1""",
    base=False,
)
def certifications(c: Corpus) -> DataFrame:
    """Release entries made of order lines: open ones carry a rating mark, others one that isn't a rating."""
    mark = F.when(F.col("l_linestatus") != "O", "NR").when(F.col("l_returnflag") == "R", " r ").when(F.col("l_returnflag") == "N", "X").when(F.col("l_returnflag") == "A", "PG-13")
    entry = F.struct((F.col("l_linenumber") % 4).cast("int").alias("type"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("release_date"), mark.alias("certification"))
    films = c.table("lineitem").groupBy(F.col("l_orderkey").alias("film_id")).agg(F.collect_list(entry).alias("entries"))
    return films.select("film_id", corpus.pick_certification(F.col("entries")).alias("rating")).where("rating IS NOT NULL")


@query("events_by_hour", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL", base=False)
def events_by_hour(c: Corpus) -> DataFrame:
    return c.table("events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
