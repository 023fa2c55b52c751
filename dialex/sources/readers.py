"""Sources: tab-separated dumps, one-object JSON files, word lists, block lists, line-structured dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialex.functions.text import title_case


def tsv(spark: SparkSession, path: str) -> DataFrame:
    r"""A tab-separated dump with a header, no quoting, \N for null; every column a string."""
    return spark.read.csv(path, sep="\t", header=True, quote="", nullValue="\\N")


def json_objects(spark: SparkSession, path: str, schema: str, key: str = "film_id") -> DataFrame:
    """A file an object; files that hold null, or lack the key, have no row."""
    return spark.read.schema(schema).option("multiLine", True).json(path).where(F.col(key).isNotNull())


def ndjson(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An object a line; without a schema, one is inferred from all lines."""
    return (spark.read.schema(schema) if schema else spark.read.option("samplingRatio", 1.0)).json(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): the lines of a text file but for empty ones and those that start with #."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' AND NOT word LIKE '#%'").distinct()


def first_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(film_id): the first word of each line, for lists of ids with remarks."""
    return word_list(spark, path).select(F.split("word", r"\s+")[0].alias("film_id")).distinct()


def block_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(blocked ids, blocked files) of lines `film_id [name [remark]]`."""
    parts = word_list(spark, path).select(F.split("word", r"\s+").alias("p"))
    ids = parts.where(F.size("p") == 1).select(F.col("p")[0].alias("film_id"))
    return ids, parts.where(F.size("p") > 1).select(F.col("p")[0].alias("film_id"), F.col("p")[1].alias("name"))


def ordered_words(spark: SparkSession, words: list[str]) -> DataFrame:
    """(place, word): a list of words in order, each where it first comes."""
    return spark.createDataFrame(list(enumerate(dict.fromkeys(words))), "place int, word string")


def _latin1() -> Column:
    """A text line's bytes read as Latin-1; the text reader passes bytes on as they are."""
    return F.decode(F.col("value").cast("binary"), "ISO-8859-1")


def dialogue_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, character_id, film_id, character, text) of ' +++$+++ '-separated lines in Latin-1."""
    names = ["line_id", "character_id", "film_id", "character", "text"]
    parts = F.split(_latin1(), r" \+\+\+\$\+\+\+ ")
    return spark.read.text(path).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def dialogue_films(spark: SparkSession, path: str) -> DataFrame:
    """(film_id, title, year, rating, votes, genres) of the metadata beside dialogue lines; genres once each."""
    parts = F.split(_latin1(), r" \+\+\+\$\+\+\+ ")
    at = lambda i: F.get(parts, F.lit(i))
    genres = F.array_distinct(F.transform(F.regexp_extract_all(at(5), F.lit("'([^']+)'"), 1), title_case))
    return spark.read.text(path).select(at(0).alias("film_id"), title_case(at(1)).alias("title"), F.regexp_extract(at(2), r"(\d{4})", 1).try_cast("int").alias("year"), at(3).try_cast("double").alias("rating"), at(4).try_cast("int").alias("votes"), genres.alias("genres"))


def dialogue_docs(lines: DataFrame, min_words: int = 500) -> DataFrame:
    """(film_id, text) of dialogue lines, for films with enough words."""
    docs = lines.groupBy("film_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    return docs.where(F.regexp_count("text", F.lit(r"\S+")) >= min_words)


def credits(spark: SparkSession, path: str, most: int = 40) -> DataFrame:
    """(film_id, character, actor): the cast of landed credit records, the first so many."""
    rows = json_objects(spark, path, "film_id string, characters array<string>, actors array<string>")
    pairs = F.slice(F.arrays_zip("characters", "actors"), 1, most)
    return rows.select("film_id", F.explode(pairs).alias("c")).select("film_id", F.col("c.characters").alias("character"), F.col("c.actors").alias("actor"))


_NAMED = "array<struct<name:string,english_name:string>>"
DETAIL = (
    f"id long, original_title string, overview string, tagline string, runtime int, release_date string, status string, homepage string, adult boolean, "
    f"belongs_to_collection struct<id:long,name:string>, budget long, revenue long, popularity double, vote_average double, vote_count long, genres {_NAMED}, "
    f"keywords struct<keywords:{_NAMED}>, spoken_languages {_NAMED}, production_countries {_NAMED}, production_companies {_NAMED}, "
    "credits struct<cast:array<struct<name:string,character:string,order:int>>,crew:array<struct<name:string,job:string>>>"
)


def detail_record(raw: Column) -> Column:
    """A flat record of a detail document (JSON): defaults for what is missing, the cast by order, crew by job."""
    return _flat_record(F.from_json(raw, DETAIL))


def drifting_record(detail: Column) -> Column:
    """`detail_record` of a VARIANT, taken field by field. A number that comes as a string is the number; a field of
    another kind than it should be, an object for a number or a name for a list, is missing, and no other field with it."""
    fields = [F.try_variant_get(detail, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in T._parse_datatype_string(DETAIL).fields]
    return _flat_record(F.struct(*fields))


def landed_details(spark: SparkSession, path: str) -> DataFrame:
    """(film_id, fetched_at, detail) of lines {film_id, fetched_at, detail}, the detail as VARIANT, parsed once. Lines
    that are no JSON or have no film are left out, and so are those without a detail, as of films that have none."""
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    text = lambda field: F.try_variant_get("v", f"$.{field}", "string")
    rows = lines.select(text("film_id").alias("film_id"), text("fetched_at").alias("fetched_at"), F.try_variant_get("v", "$.detail", "variant").alias("detail"))
    return rows.where(F.col("film_id").isNotNull() & F.col("detail").isNotNull() & ~F.is_variant_null("detail"))


def latest(rows: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The row of each key with the largest `at`, and of those the largest of `ties`; rows without `at` come last."""
    newest = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), *[F.desc_nulls_last(t) for t in ties])
    return rows.withColumn("_newest", F.row_number().over(newest)).where("_newest = 1").drop("_newest")


def release_entries(spark: SparkSession, path: str) -> DataFrame:
    """(film_id, entries) of landed release records {film_id, us}: the release entries (type, release_date,
    certification) of a film's home market, an object a line or a file; one may be null, and a film may have none."""
    entries = "array<struct<type:int,release_date:string,certification:string>>"
    rows = ndjson(spark, path, f"film_id string, us {entries}").where("film_id IS NOT NULL")
    return rows.select("film_id", F.coalesce("us", F.array().cast(entries)).alias("entries"))


def _flat_record(d: Column) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0))
    some = lambda a: F.coalesce(a, F.array())
    names = lambda a: F.coalesce(F.transform(F.filter(a, lambda x: text(x["name"]) != ""), lambda x: x["name"]), F.array().cast("array<string>"))
    crew = lambda *jobs: F.coalesce(F.array_distinct(F.transform(F.filter(d["credits"]["crew"], lambda x: x["job"].isin(*jobs) & (text(x["name"]) != "")), lambda x: x["name"])), F.array().cast("array<string>"))
    placed = F.transform(F.filter(d["credits"]["cast"], lambda x: text(x["name"]) != ""), lambda x, i: F.struct(F.coalesce(x["order"], F.lit(1_000_000)).alias("at"), i.alias("i"), x["name"].alias("name"), text(x["character"]).alias("character"), number(x["order"]).alias("order")))
    cast = F.transform(F.slice(F.array_sort(placed), 1, 20), lambda x: F.struct(x["name"].alias("name"), x["character"].alias("character"), x["order"].alias("order")))
    spoken = F.filter(F.transform(d["spoken_languages"], lambda x: F.coalesce(F.nullif(x["english_name"], F.lit("")), F.nullif(x["name"], F.lit("")))), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    return F.struct(
        d["id"].alias("tmdb_id"), text(d["original_title"]).alias("original_title"), text(d["overview"]).alias("overview"), text(d["tagline"]).alias("tagline"), number(d["runtime"]).alias("runtime"), text(d["release_date"]).alias("release_date"),
        text(d["status"]).alias("status"), text(d["homepage"]).alias("homepage"), F.coalesce(d["adult"], F.lit(False)).alias("adult"), d["belongs_to_collection"]["id"].alias("collection_id"), d["belongs_to_collection"]["name"].alias("collection_name"),
        number(d["budget"]).alias("budget"), number(d["revenue"]).alias("revenue"), d["popularity"].alias("tmdb_popularity"), d["vote_average"].alias("tmdb_vote_average"), d["vote_count"].alias("tmdb_vote_count"),
        names(d["genres"]).alias("tmdb_genres"), names(d["keywords"]["keywords"]).alias("keywords"), F.coalesce(spoken, none).alias("spoken_languages"), names(d["production_countries"]).alias("production_countries"),
        names(d["production_companies"]).alias("production_companies"), crew("Director").alias("director"), crew("Writer", "Screenplay", "Story", "Novel", "Author").alias("writers"),
        F.get(crew("Original Music Composer", "Music", "Composer"), F.lit(0)).alias("composer"), F.get(crew("Director of Photography", "Cinematography"), F.lit(0)).alias("cinematographer"), crew("Producer").alias("producers"),
        F.coalesce(cast, F.array().cast("array<struct<name:string,character:string,order:int>>")).alias("cast"),
    )


def blurb(record: Column) -> Column:
    """The non-empty ones of overview, tagline and runtime, as JSON."""
    return F.to_json(F.struct(F.nullif(record["overview"], F.lit("")).alias("overview"), F.nullif(record["tagline"], F.lit("")).alias("tagline"), F.nullif(record["runtime"], F.lit(0)).alias("runtime")))


def part(df: DataFrame, langs: list[str], column: str = "lang") -> DataFrame:
    """All rows for no languages, else those of the languages; several are put together exactly."""
    return df if not langs else df.where(F.col(column).isin(*langs))
