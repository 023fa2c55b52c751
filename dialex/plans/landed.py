"""Queries: tables written in the formats that sources land in or sinks leave, and read back by the engine's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialex.operators import corpus as ops
from dialex.plans.catalog import query
from dialex.plans.corpus import Corpus
from dialex.sources import readers, writers
from dialex.sources.scratch import scratch
from dialex.streaming.incremental import count_new


def _landed(df: DataFrame, tag: str, line: Column, files: bool = False) -> str:
    """Writes a line of text a row, or a file a row."""
    path = scratch(df.sparkSession, tag)
    out = df.select(line.alias("value")).write
    (out.option("maxRecordsPerFile", 1) if files else out).text(path)
    return path


def _tt(c: str) -> Column:
    return F.concat(F.lit("tt"), F.col(c).cast("string"))


@query("dump_read", """SELECT 'tt' || doc_id AS film_id, '"Film" ' || doc_id AS title, CASE WHEN doc_id % 10 <> 0 THEN n_chars END AS votes, source AS genres FROM documents""", base=False)
def dump_read(c: Corpus) -> DataFrame:
    r"""A tab-separated, compressed dump without quoting and with \N for null."""
    path = scratch(c.spark, "dump")
    rows = c.table("documents").select(_tt("doc_id").alias("film_id"), F.concat(F.lit('"Film" '), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")).alias("votes"), F.col("source").alias("genres"))
    rows.write.csv(path, sep="\t", header=True, quote="", nullValue="\\N", compression="gzip")
    return readers.tsv(c.spark, path).select("film_id", "title", F.col("votes").cast("long").alias("votes"), "genres")


@query("objects_read", "SELECT 'tt' || n_nationkey AS film_id, n_name AS original_language FROM nation WHERE n_nationkey % 5 <> 0", base=False)
def objects_read(c: Corpus) -> DataFrame:
    """A file an object, over several lines; a file may hold null."""
    key = F.col("n_nationkey")
    record = F.replace(F.to_json(F.struct(_tt("n_nationkey").alias("film_id"), F.col("n_name").alias("original_language"))), F.lit(","), F.lit(",\n"))
    path = _landed(c.table("nation"), "objects", F.when(key % 5 == 0, "null").otherwise(record), files=True)
    return readers.json_objects(c.spark, path, "film_id string, original_language string")


@query("credits_read", "SELECT 'tt' || n_nationkey AS film_id, unnest([n_name, 'Guest']) AS character, unnest([n_name || ' Jr.', NULL]) AS actor FROM nation WHERE n_nationkey % 5 <> 0", base=False)
def credits_read(c: Corpus) -> DataFrame:
    """The cast of landed credit records; a character may lack its actor."""
    name = F.col("n_name")
    record = F.to_json(F.struct(_tt("n_nationkey").alias("film_id"), F.array(name, F.lit("Guest")).alias("characters"), F.array(F.concat(name, F.lit(" Jr."))).alias("actors")))
    return readers.credits(c.spark, _landed(c.table("nation"), "credits", F.when(F.col("n_nationkey") % 5 == 0, "null").otherwise(record), files=True))


@query("ndjson_read", "SELECT event_id, event_type, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM events", base=False)
def ndjson_read(c: Corpus) -> DataFrame:
    """Objects a line, nested, some without a field; the schema is inferred from all lines."""
    some = F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value")
    path = _landed(c.table("events"), "lines", F.to_json(F.struct("event_id", F.struct("event_type", "user_id", some).alias("detail"))))
    return readers.ndjson(c.spark, path).select("event_id", "detail.event_type", "detail.user_id", F.col("detail.value").alias("value"))


@query("block_list_read", "SELECT 'tt' || doc_id AS film_id, CASE WHEN doc_id % 7 = 1 THEN doc_id || '.xml' END AS name FROM documents WHERE doc_id % 7 < 2", base=False)
def block_list_read(c: Corpus) -> DataFrame:
    """Blocked films, and blocked files of films, from lines with remarks."""
    d, name = F.col("doc_id"), F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(".xml wrong film"))
    line = F.when(d % 7 == 0, _tt("doc_id")).when(d % 7 == 1, F.concat(_tt("doc_id"), name)).when(d % 7 == 2, F.concat(F.lit("# "), _tt("doc_id"))).otherwise("")
    ids, files = readers.block_list(c.spark, _landed(c.table("documents"), "blocked", line))
    return ids.withColumn("name", F.lit(None).cast("string")).unionByName(files)


@query("verified_read", "SELECT DISTINCT 'tt' || doc_id AS film_id FROM documents WHERE doc_id % 4 < 2", base=False)
def verified_read(c: Corpus) -> DataFrame:
    """The ids that lines of ids with remarks begin with."""
    d = F.col("doc_id")
    line = F.when(d % 4 == 0, F.concat(_tt("doc_id"), F.lit("  checked by hand"))).when(d % 4 == 1, _tt("doc_id")).otherwise(F.concat(F.lit("#"), _tt("doc_id")))
    return readers.first_tokens(c.spark, _landed(c.table("documents"), "verified", line))


@query("word_list_read", "SELECT word FROM dict")
def word_list_read(c: Corpus) -> DataFrame:
    """A list with blanks, empty lines, remarks and words twice."""
    lines = c.dictionary.select(F.explode(F.array(F.concat(F.lit(" "), "word", F.lit(" ")), F.col("word"), F.lit(""), F.concat(F.lit("# "), "word"))).alias("line"))
    return readers.word_list(c.spark, _landed(lines, "list", F.col("line")))


@query("dialogue_read", r"""SELECT 'L' || conv_id || '-' || turn AS line_id, 'u' || turn AS character_id, 'm' || conv_id AS film_id, role AS character,
regexp_replace(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g'), '[^\x00-\x{FF}]', '?', 'g') AS text FROM conversations""", base=False)
def dialogue_read(c: Corpus) -> DataFrame:
    """Lines of dialogue in Latin-1."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " "), r"[^\x00-\xFF]", "?")
    line = F.concat_ws(" +++$+++ ", F.concat(F.lit("L"), conv, F.lit("-"), turn), F.concat(F.lit("u"), turn), F.concat(F.lit("m"), conv), "role", text)
    return readers.dialogue_lines(c.spark, _landed(c.table("conversations"), "dialogue", F.encode(line, "ISO-8859-1").cast("string")))


@query("detail_records", """SELECT doc_id, doc_id AS tmdb_id, source AS overview, (doc_id % 3)::INT AS runtime, lang || ',extra' AS players, 'D' AS director, 'W,D' AS writers, 'Drama' AS genres,
'{"overview":"' || source || CASE WHEN doc_id % 3 = 0 THEN '"}' ELSE '","runtime":' || doc_id % 3 || '}' END AS blurb FROM documents""", base=False)
def detail_records(c: Corpus) -> DataFrame:
    """Flat records of detail documents: the cast by its order, crew by job and once each, defaults, and the blurb."""
    person = lambda name, job: F.struct(F.lit(name).alias("name"), F.lit(job).alias("job"))
    cast = F.array(F.struct(F.lit("extra").alias("name"), F.lit(None).cast("int").alias("order")), F.struct(F.col("lang").alias("name"), F.lit(1).alias("order")))
    crew = F.array(person("D", "Director"), person("D", "Director"), person("W", "Story"), person("D", "Writer"), person("", "Novel"))
    raw = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("source").alias("overview"), (F.col("doc_id") % 3).alias("runtime"), F.array(F.struct(F.lit("Drama").alias("name")), F.struct(F.lit("").alias("name"))).alias("genres"), F.struct(cast.alias("cast"), crew.alias("crew")).alias("credits")))
    r = F.col("r")
    joined = lambda a: F.array_join(a, ",")
    return c.table("documents").select("doc_id", readers.detail_record(raw).alias("r")).select(
        "doc_id", "r.tmdb_id", "r.overview", "r.runtime", joined(r["cast"]["name"]).alias("players"), joined(r["director"]).alias("director"), joined(r["writers"]).alias("writers"), joined(r["tmdb_genres"]).alias("genres"), readers.blurb(r).alias("blurb"),
    )


@query("words_tables_read", "SELECT 'film' AS layout, film_id, word, count FROM words UNION ALL SELECT 'word', film_id, word, count FROM words")
def words_tables_read(c: Corpus) -> DataFrame:
    """The words as written in both orders."""
    path = scratch(c.spark, "words")
    writers.words_tables(c.words, path)
    layout = lambda name, by: c.spark.read.parquet(f"{path}/{name}").select(F.lit(by).alias("layout"), "film_id", "word", "count")
    return layout("words_by_movie", "film").unionAll(layout("words_by_word", "word"))


@query("documents_read", """SELECT doc_id::VARCHAR AS key, '{"lang":"' || lang || '","votes":' || n_chars || '}' AS payload FROM documents""", base=False)
def documents_read(c: Corpus) -> DataFrame:
    """Documents by key, as JSON lines."""
    path = scratch(c.spark, "keyed")
    writers.documents(c.table("documents").select(F.col("doc_id").cast("string").alias("key"), F.to_json(F.struct("lang", F.col("n_chars").alias("votes"))).alias("payload")), path)
    return readers.ndjson(c.spark, path, "key string, payload string")


@query("selection_read", """SELECT doc_id AS film_id, '["' || source || '"]' AS flags, '{"lang":"' || lang || '"}' AS context, n_chars AS bytes FROM documents""", base=False)
def selection_read(c: Corpus) -> DataFrame:
    """A table of choices, its nested columns as JSON."""
    path = scratch(c.spark, "selection")
    writers.selection_table(c.table("documents").select(F.col("doc_id").alias("film_id"), F.array("source").alias("flags"), F.struct("lang").alias("context"), F.col("n_chars").alias("bytes")), path)
    return c.spark.read.parquet(path)


@query("count_cache", "SELECT film_id::VARCHAR AS film_id, word, count FROM counts")
def count_cache(c: Corpus) -> DataFrame:
    """Counts through the cache, in two batches that overlap; nothing is counted twice."""
    cache = writers.CountCache(c.spark, scratch(c.spark, "cache"), 1)
    docs = c.table("documents").select(F.col("doc_id").cast("string").alias("film_id"), "text")
    count_new(cache, docs.where("film_id % 3 = 0"))
    count_new(cache, docs)
    return cache.counts(docs.withColumn("inputs", cache.inputs("text")))


@query("language_parts", "SELECT 'all' AS part, doc_id, lang FROM documents UNION ALL SELECT 'one', doc_id, lang FROM documents WHERE lang = 'en' UNION ALL SELECT 'many', doc_id, lang FROM documents WHERE lang IN ('de', 'fr')", base=False)
def language_parts(c: Corpus) -> DataFrame:
    """All rows for no languages, those of one, those of several."""
    path = scratch(c.spark, "baked")
    c.table("documents").select("doc_id", "lang").write.partitionBy("lang").parquet(path)
    baked = c.spark.read.schema("doc_id long, lang string").parquet(path)
    asked = {"all": [], "one": ["en"], "many": ["de", "fr"]}
    one, two, three = (readers.part(baked, langs).select(F.lit(name).alias("part"), "doc_id", "lang") for name, langs in asked.items())
    return one.unionAll(two).unionAll(three)


@query("drifting_details", """SELECT doc_id, doc_id AS tmdb_id, source AS overview, CASE WHEN doc_id % 4 < 2 THEN 90 ELSE 0 END::INT AS runtime, CASE WHEN doc_id % 3 = 0 THEN 'Drama,War' ELSE '' END AS genres,
CASE WHEN doc_id % 2 = 1 THEN 'C' || lang END AS collection_name FROM documents WHERE doc_id % 11 <> 0""", base=False)
def drifting_details(c: Corpus) -> DataFrame:
    """Landed details whose fields drift from kind to kind, twice for each film, of which the later counts; some films
    have none."""
    d = F.col("doc_id")
    runtime = F.when(d % 4 == 0, '"90"').when(d % 4 == 1, "90").when(d % 4 == 2, "null").otherwise('{"minutes":90}')
    genres = F.when(d % 3 == 0, '[{"name":"Drama"},{"name":""},{"name":"War"}]').when(d % 3 == 1, "null").otherwise('{"name":"Drama"}')
    collection = F.when(d % 2 == 1, F.concat(F.lit('{"id":7,"name":"C'), "lang", F.lit('"}'))).otherwise(F.when(d % 4 == 0, "null").otherwise('"none"'))
    number = F.when(d % 5 == 0, F.concat(F.lit('"'), d.cast("string"), F.lit('"'))).otherwise(d.cast("string"))

    def line(at, overview, whole):
        detail = F.concat(F.lit('{"id":'), number, F.lit(',"overview":"'), overview, F.lit('","runtime":'), runtime, F.lit(',"genres":'), genres, F.lit(',"belongs_to_collection":'), collection, F.lit("}"))
        return F.concat(F.lit('{"film_id":"'), d.cast("string"), F.lit(f'","fetched_at":"{at}","detail":'), F.when(whole, detail).otherwise("null"), F.lit("}"))

    docs = c.table("documents")
    lines = [docs.select(line(at, text, d % 11 != 0).alias("line")) for at, text in (("2026-02-01", F.col("source")), ("2025-12-31", F.lit("older")))]
    landed = readers.landed_details(c.spark, _landed(lines[0].unionAll(lines[1]), "details", F.col("line")))
    r = readers.latest(landed, "film_id", "fetched_at").select(F.col("film_id").cast("long").alias("doc_id"), readers.drifting_record(F.col("detail")).alias("r"))
    return r.select("doc_id", "r.tmdb_id", "r.overview", "r.runtime", F.array_join("r.tmdb_genres", ",").alias("genres"), "r.collection_name")


@query("landed_certifications", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'r' WHEN doc_id % 3 = 1 AND doc_id % 5 <> 0 THEN 'pg' END AS rating FROM documents WHERE doc_id % 7 <> 0""", base=False)
def landed_certifications(c: Corpus) -> DataFrame:
    """Certifications picked from landed release entries: theatrical before others, then by date; marks without a code
    and films without entries have none."""
    d = F.col("doc_id")
    entry = lambda kind, day, mark: F.struct(F.lit(kind).alias("type"), F.lit(day).alias("release_date"), F.lit(mark).alias("certification"))
    us = F.when(d % 3 == 0, F.array(entry(4, "1990-01-01", "G"), entry(3, "1999-05-05", " r "), entry(3, "2001-01-01", "PG"))).when((d % 3 == 1) & (d % 5 != 0), F.array(entry(3, "1999-01-01", "NR"), entry(1, "2000-01-01", "PG")))
    record = F.to_json(F.struct(d.cast("string").alias("film_id"), us.alias("us")))
    path = _landed(c.table("documents"), "releases", F.when(d % 7 == 0, "null").otherwise(record))
    entries = readers.release_entries(c.spark, path)
    return entries.select(F.col("film_id").cast("long").alias("doc_id"), ops.pick_certification(F.col("entries")).alias("rating"))
