"""The tables of a corpus as the operators want them, built from a folder of Parquet tables.

Documents are films: the source is the genre, the number of characters stands for votes, and the year and running time,
which documents lack, are derived from the id. Labels of low quality give the tier.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.functions.lexicon import PROFANITY, STOPWORDS
from dialex.operators import corpus as ops
from dialex.operators import signatures

BASE_SQL = r"""
tok AS (
  SELECT doc_id AS film_id, unnest(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}_'']+')) AS word FROM documents
), counts AS MATERIALIZED (
  SELECT film_id, word, count(*)::BIGINT AS count FROM tok
  WHERE regexp_full_match(word, '[a-z'']+') AND (length(word) > 1 OR word IN ('a', 'i')) GROUP BY ALL
), stats AS (
  SELECT film_id, sum(count)::BIGINT AS total_words, count(*)::INT AS unique_words FROM counts GROUP BY film_id
), low AS (
  SELECT doc_id AS film_id, 'low' AS tier FROM labels WHERE quality = 0
), all_films AS (
  SELECT d.doc_id AS film_id, 'Film ' || d.doc_id AS title, (1930 + d.doc_id % 96)::INT AS year,
         CASE WHEN d.doc_id % 10 <> 0 THEN (20 + d.doc_id % 100)::INT END AS runtime_minutes,
         [d.source] AS genres, d.lang, d.n_chars AS votes, s.total_words, s.unique_words,
         s.total_words / (CASE WHEN d.doc_id % 10 <> 0 THEN (20 + d.doc_id % 100) END)::DOUBLE AS words_per_minute,
         coalesce(low.tier, 'ok') AS quality
  FROM documents d JOIN stats s ON s.film_id = d.doc_id LEFT JOIN low ON low.film_id = d.doc_id
), films AS (SELECT * FROM all_films WHERE quality = 'ok'),
words AS (SELECT c.* FROM counts c WHERE film_id IN (SELECT film_id FROM films)),
word_year AS MATERIALIZED (
  SELECT word, year, sum(count)::BIGINT AS count, count(DISTINCT film_id)::BIGINT AS movie_count
  FROM words JOIN films USING (film_id) GROUP BY word, year QUALIFY sum(sum(count)) OVER (PARTITION BY word) >= 20
), dict AS (SELECT word, sum(count)::BIGINT AS count, count(*)::BIGINT AS films FROM words GROUP BY word),
meta AS (
  SELECT word, zipf, pos AS classes, pos,
         coalesce(nullif(round(log2((count / (SELECT sum(count) FROM dict) * 1e6) / pow(10.0, greatest(zipf, 1.0) - 3)), 2), 0), 0)::DOUBLE AS dist
  FROM (SELECT word, count, 1.0::DOUBLE + length(count::VARCHAR) AS zipf,
               CASE WHEN word LIKE '%ly' THEN 'r' WHEN word LIKE '%ing' OR word LIKE '%ed' THEN 'v'
                    WHEN word LIKE '%ble' OR word LIKE '%ous' THEN 'a' WHEN length(word) >= 4 THEN 'n' ELSE 'x' END AS pos
        FROM dict)
), ratings AS (
  SELECT film_id, CASE film_id % 6 WHEN 0 THEN 'g' WHEN 1 THEN 'pg' WHEN 2 THEN 'pg13' WHEN 3 THEN 'r' WHEN 4 THEN 'nc17' END AS rating
  FROM films WHERE film_id % 6 < 5
)"""


def stop_sql(words: tuple[str, ...] = STOPWORDS) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


#: Bytes of documents, as they lie in files, to a partition; and of a shuffle, as it lies on disk, to a task. Their words
#: are some 20 times as large in memory, where a task groups them twice and sorts them.
SHARE, READ_AT_ONCE = 6 << 20, "16m"


class Corpus:
    """The tables of one folder. Word counts are kept while the session lives: everything else starts from them, and
    they are smaller than the texts."""

    _known: dict[tuple[str, str], Corpus] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Corpus:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        cls._known[key].make_room()
        return cls._known[key]

    def make_room(self) -> None:
        """Raises the session's number of shuffle partitions where it is too small for these documents, so that what a
        task groups or sorts fits in memory at any size; adaptive execution puts small partitions together, up to a size
        that the user may have set."""
        n = self.partitions
        if n > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            self.spark.conf.set("spark.sql.shuffle.partitions", n)
            together = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
            if self.spark.conf.get(together, None) is None:
                self.spark.conf.set(together, READ_AT_ONCE)

    def close(self) -> None:
        """Frees what is kept of this folder; the next use reads it again."""
        self._known.pop((self.spark.sparkContext.applicationId, self.sf_dir), None)
        for name in ("counts", "all_films", "dictionary", "word_year", "word_year_lang", "entity_counts"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def counts(self) -> DataFrame:
        docs = self.table("documents").select(F.col("doc_id").alias("film_id"), "text")
        # Texts are dealt by film, not their counts, which are several times as large. Counts, and joins of them by film,
        # then need no shuffle. The number of partitions is stated, as others may be coalesced, and joins shuffle these again.
        docs = docs.repartition(self.partitions, "film_id")
        return ops.word_counts(docs).sortWithinPartitions("film_id").persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def input_bytes(self) -> int:
        """The size of the documents' files, as Spark lists them."""
        return int(self.table("documents")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())

    @property
    def partitions(self) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.input_bytes // SHARE))

    @cached_property
    def curated(self) -> DataFrame:
        d = F.col("doc_id")
        runtime = F.when(d % 10 != 0, (20 + d % 100).cast("int"))
        return self.table("documents").select(
            d.alias("film_id"), F.concat(F.lit("Film "), d.cast("string")).alias("title"), (1930 + d % 96).cast("int").alias("year"), runtime.alias("runtime_minutes"),
            F.array("source").alias("genres"), F.col("n_chars").alias("votes"),
        )

    @cached_property
    def all_films(self) -> DataFrame:
        languages = self.table("documents").select(F.col("doc_id").alias("film_id"), "lang")
        low = self.table("labels").where("quality = 0").select(F.col("doc_id").alias("film_id"), F.lit("low").alias("tier"), F.array(F.lit("label")).alias("flags"))
        return ops.all_films(self.curated, ops.film_stats(self.counts, self.curated), languages, low).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def films(self) -> DataFrame:
        return ops.ok_films(self.all_films)

    @cached_property
    def words(self) -> DataFrame:
        return ops.words_of(self.counts, self.films)

    @cached_property
    def flagged_words(self) -> DataFrame:
        return ops.words_of(self.counts, ops.flagged_films(self.all_films))

    @cached_property
    def dictionary(self) -> DataFrame:
        return ops.dictionary(self.words).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def word_year(self) -> DataFrame:
        return ops.word_year(self.words, self.films).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def word_year_lang(self) -> DataFrame:
        """Kept, as boards of several languages read it several times each."""
        return ops.word_year(self.words, self.films, by=("lang",)).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def entity_counts(self) -> DataFrame:
        """Words of decades and genres, from which all signatures start."""
        return signatures.entity_counts(self.words, self.films)[0].persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def entity_sizes(self) -> DataFrame:
        return signatures.entity_counts(self.words, self.films)[1]

    @cached_property
    def lexicon(self) -> DataFrame:
        """A stand-in for a lexicon: frequency by the number of digits of the count, part of speech by ending."""
        w = F.col("word")
        pos = F.when(w.endswith("ly"), "r").when(w.endswith("ing") | w.endswith("ed"), "v").when(w.endswith("ble") | w.endswith("ous"), "a").when(F.length(w) >= 4, "n").otherwise("x")
        return self.dictionary.select("word", (1.0 + F.length(F.col("count").cast("string"))).alias("zipf"), pos.alias("classes"), pos.alias("pos"))

    @cached_property
    def meta(self) -> DataFrame:
        return ops.word_meta(self.dictionary, self.lexicon)

    @cached_property
    def ratings(self) -> DataFrame:
        codes = F.array(*[F.lit(c) for c in ("g", "pg", "pg13", "r", "nc17")])
        return self.films.where("film_id % 6 < 5").select("film_id", codes[(F.col("film_id") % 6).cast("int")].alias("rating"))

    stopwords = STOPWORDS
    profanity = PROFANITY
