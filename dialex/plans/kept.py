"""Queries: what is kept between runs and brought up to date, and how single documents and members are reached."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialex.functions import text
from dialex.operators import selection, slices
from dialex.plans.audits import _CHOICE, TALK, files_and_films
from dialex.plans.catalog import query
from dialex.plans.corpus import Corpus
from dialex.sources import archives, payloads
from dialex.sources.film_cache import FilmCache
from dialex.sources.scratch import listed, scratch
from dialex.streaming.aggregates import RunningAggregates

ARCHIVE_BYTES = 4 << 20


def _archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, content) as zip archives of some MB each, every other member deflated."""
    out = zipped = None
    for batch in batches:
        for i, (name, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if zipped is None:
                out = io.BytesIO()
                zipped = zipfile.ZipFile(out, "w")
            zipped.writestr(name, content, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
            if out.tell() > ARCHIVE_BYTES:
                zipped.close()
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()])], names=["zip"])
                zipped = None
    if zipped is not None:
        zipped.close()
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()])], names=["zip"])


@query("archive_members", "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, md5(coalesce(text, '')) AS digest FROM documents", base=False)
def archive_members(c: Corpus) -> DataFrame:
    """Documents written as members of zip archives, and read back by one ranged read each."""
    named = c.table("documents").select(F.concat(F.lit("raw/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    path = scratch(c.spark, "archives")
    named.mapInArrow(_archived, "zip binary").select(F.col("zip").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    members = archives.zip_directory(c.spark, [f"{path}/{n}" for n in listed(c.spark, path) if n.startswith("part-")])
    got = archives.zip_contents(members)
    return got.select(F.regexp_extract("name", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), "bytes", F.md5("content").alias("digest"))


_STRICT = "stop_share < CASE WHEN sm.film_id % 3 = 0 THEN 0.3 ELSE 0.1 END AS flag"
_CHOSEN = _CHOICE.replace("stop_share < 0.1 AS flag", _STRICT).rpartition("\nSELECT fl.film_id")


def _files_read(c: Corpus):
    """A reader for FilmCache: the words of files, and a row without one for each file."""
    docs = c.table("documents").select(F.expr("doc_id div 12").alias("film_id"), F.format_string("%06d.xml", F.col("doc_id")).alias("name"), (F.col("n_chars") * 12).alias("bytes"), "text")

    def read(files: DataFrame) -> DataFrame:
        own = docs.join(files.select("film_id", "name"), ["film_id", "name"], "left_semi")
        words = text.token_rows(own.withColumn("file", F.struct("film_id", "name", "bytes")), "file", "text").groupBy("file", "word").agg(F.count("*").alias("count"))
        marks = own.select("film_id", "name", "bytes", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("count"))
        return words.select("file.film_id", "file.name", "file.bytes", "word", "count").unionByName(marks)

    return read


def choose_in_context(files: DataFrame) -> DataFrame:
    """The rule of the queries below: files with few stopwords are flagged, and more so where a film's context is strict."""
    low = F.col("stop_share") < F.when(F.col("context.strict"), 0.3).otherwise(0.1)
    flags = F.when(low, F.array(F.lit("asr"))).otherwise(F.array().cast("array<string>"))
    chosen = selection.choose(files.withColumns({"gate": selection.gate(), "flags": flags}))
    return chosen.select("film_id", "name", "reason", "cluster", "usable", "relaxed", "tier", "flags")


def films_to_choose(c: Corpus, strict) -> DataFrame:
    files, films = files_and_films(c)
    ranked = selection.sample_candidates(selection.rank_candidates(files, films))
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])
    return ranked.groupBy("film_id").agg(names.alias("candidates")).join(films, "film_id").select("film_id", "candidates", "runtime_minutes", F.struct(strict.alias("strict")).alias("context"))


def rechosen(c: Corpus) -> tuple[FilmCache, list, DataFrame]:
    """A cache after a run without strict films and one with a third of them strict; what the runs did; the films."""
    cache, did = FilmCache(c.spark, scratch(c.spark, "film-cache"), 1, 1, 8), []
    for strict in (F.lit(False), F.col("film_id") % 3 == 0):
        films = films_to_choose(c, strict)
        did.append(cache.update(films, _files_read(c), lambda words, sizes: selection.fingerprints(words, sizes, c.stopwords, TALK), choose_in_context))
    return cache, did, films


@query("rechosen_counts", f"{_CHOSEN[0]}, choice AS (SELECT fl.film_id{_CHOSEN[2]}) SELECT film_id, word, count FROM fw JOIN choice USING (film_id, name)", recursive=True)
def rechosen_counts(c: Corpus) -> DataFrame:
    """Counts of the chosen files after the context of a third of the films has changed: chosen anew from kept
    fingerprints, with changed winners counted."""
    cache, _, films = rechosen(c)
    return cache.counts(films)


_BATCHES = r"""WITH d AS (SELECT doc_id, (1930 + doc_id % 96)::INT AS year, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN text ELSE text || ' ' || source END AS text FROM documents WHERE doc_id % 7 <> 0),
k AS (SELECT doc_id, year, unnest(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}_'']+')) AS word FROM d)
SELECT word, year, count(*)::BIGINT AS count, count(DISTINCT doc_id)::BIGINT AS movie_count FROM k
WHERE regexp_full_match(word, '[a-z'']+') AND (length(word) > 1 OR word IN ('a', 'i')) GROUP BY word, year QUALIFY sum(count(*)) OVER (PARTITION BY word) >= 20"""


@query("merged_batches", _BATCHES, base=False)
def merged_batches(c: Corpus) -> DataFrame:
    """Yearly counts after three batches: two thirds of the films, then the rest and some again with another text, then
    removals."""
    d = F.col("doc_id")
    docs = lambda body, turn: c.table("documents").select(d.cast("string").alias("film_id"), (1930 + d % 96).cast("int").alias("year"), body.alias("text"), F.lit(turn).cast("long").alias("turn"))
    sums = RunningAggregates(c.spark, scratch(c.spark, "sums"), buckets=8, compact_after=3)
    sums.add(docs(F.concat_ws(" ", "text", "source"), 0).where("film_id % 3 <> 0"), 0)
    sums.add(docs(F.col("text"), 1).where("film_id % 3 = 0 OR film_id % 5 = 0"), 1)
    sums.add(docs(F.lit(None).cast("string"), 2).where("film_id % 7 = 0"), 2)
    return sums.word_year()


@query("payload_look_up", """SELECT k.key, CASE WHEN d.doc_id IS NOT NULL THEN '{"source":"' || source || '","n":' || n_chars || '}' END AS payload, CASE WHEN d.doc_id % 3 = 0 THEN lang END AS blurb
FROM (SELECT doc_id::VARCHAR AS key FROM labels UNION ALL SELECT 'x' || conv_id FROM conversations GROUP BY conv_id) k LEFT JOIN documents d ON d.doc_id::VARCHAR = k.key""", base=False)
def payload_look_up(c: Corpus) -> DataFrame:
    """Payloads of the labelled documents, with a blurb that only a third of all documents have, and of keys that no
    document has."""
    docs = c.table("documents").withColumn("key", F.col("doc_id").cast("string"))
    store, beside = (payloads.PayloadStore(c.spark, scratch(c.spark, t), 16) for t in ("payloads", "blurbs"))
    store.write(docs.select("key", F.to_json(F.struct("source", F.col("n_chars").alias("n"))).alias("payload")))
    beside.write(docs.where("doc_id % 3 = 0").select("key", F.col("lang").alias("payload")))
    labelled = c.table("labels").select(F.col("doc_id").cast("string").alias("key"))
    unknown = c.table("conversations").select(F.concat(F.lit("x"), "conv_id").alias("key")).distinct()
    return store.look_up(labelled.unionAll(unknown), blurb=beside)


@query("routed_year_totals", """SELECT 'all' AS asked, year, sum(count)::BIGINT AS total FROM words JOIN films USING (film_id) GROUP BY year
UNION ALL SELECT 'one', year, sum(count)::BIGINT FROM words JOIN films USING (film_id) WHERE lang = 'en' GROUP BY year
UNION ALL SELECT 'some', year, sum(count)::BIGINT FROM words JOIN films USING (film_id) WHERE lang IN ('de', 'fr') GROUP BY year""")
def routed_year_totals(c: Corpus) -> DataFrame:
    """Baked yearly totals as requests reach them: for no language, for one, and merged for two."""
    said = c.words.join(c.films.select("film_id", "year", "lang"), "film_id")
    sets = said.groupBy("year", F.col("lang").alias("slice")).agg(F.sum("count").alias("total"))
    baked = payloads.BakedSlices(c.spark, scratch(c.spark, "baked"), "year_totals")
    baked.write(sets.unionByName(sets.groupBy("year").agg(F.sum("total").alias("total")).withColumn("slice", F.lit("all"))))
    merge = lambda parts: slices.merge_by_year(parts, "total")
    out = None
    for name, langs in (("all", []), ("one", ["en"]), ("some", ["de", "fr"])):
        part = baked.ask(langs, merge).select(F.lit(name).alias("asked"), "year", "total")
        out = part if out is None else out.unionByName(part)
    return out
