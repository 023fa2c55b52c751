"""Choices of files and the counts of chosen files, kept by film on two levels.

A file is read once for its fingerprint. A film's choice is kept under a key of what it depends on: the candidates in
order, the rule's version, the running time and what else is known of the film. Where only these change, the film is
chosen anew from kept fingerprints, without reading a file; only where another file wins is that file counted. A new
version of the fingerprints (of the parser, say) makes all of it stale.

Each level is a Parquet table in buckets of a hash of the film, sorted by film. An update rewrites the buckets of the films
that it touches, so rows of other versions and of lost choices go with it. The levels are written in the order in which
they are relied upon, choices last: after a failure the update is run again and does what is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.sources.scratch import delete, exists, scratch

Step = Callable[..., DataFrame]


def candidate_names(candidates: Column, name: Column) -> Column:
    """The names of a film's candidates, best first; its one file where no candidates are listed."""
    return F.when(F.coalesce(F.size(candidates), F.lit(0)) > 0, candidates).otherwise(F.array(name))


def choice_key(rule_version: int, candidates: Column, runtime: Column, context: Column) -> Column:
    """A stable key of what a choice depends on. Candidates count in their order; arrays in the context should be sorted."""
    parts = F.struct(F.lit(rule_version).alias("rule"), candidates.alias("candidates"), runtime.alias("runtime"), context.alias("context"))
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


@dataclass(frozen=True)
class Updated:
    """What an update did: films chosen anew, files read for their fingerprint, files read again for their counts, films
    whose winner changed, and films left as they were because a file couldn't be read."""

    chosen: int
    fingerprinted: int
    reread: int
    changed: int
    failed: int


class FilmCache:
    """A folder with the tables prints, counts and choices.

    films, for `update` and `counts`, has film_id, candidates (names, best first), runtime_minutes and context (a
    struct of whatever else a choice depends on); other columns are passed to the rule.
    """

    def __init__(self, spark: SparkSession, path: str, print_version: int, rule_version: int, buckets: int = 64):
        self.spark, self.path, self.print_version, self.rule_version, self.buckets = spark, path.rstrip("/"), print_version, rule_version, buckets

    def _table(self, name: str) -> DataFrame | None:
        """The rows of the present fingerprint version; None before the first update."""
        at = f"{self.path}/{name}"
        return self.spark.read.parquet(at).where(F.col("print_version") == self.print_version) if exists(self.spark, at) else None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("film_id"), F.lit(self.buckets)).cast("int")

    def _kept(self, df: DataFrame, tag: str) -> DataFrame:
        path = scratch(self.spark, tag)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _replace(self, name: str, films: DataFrame, rows: DataFrame) -> None:
        """Puts rows in the place of all that a table holds of `films`, by rewriting these films' buckets."""
        rows = rows.withColumn("print_version", F.lit(self.print_version)).withColumn("bucket", self._bucket())
        touched = [r.bucket for r in films.select(self._bucket().alias("bucket")).distinct().collect()]  # `buckets` numbers at most
        if not touched:
            return
        old = self._table(name)
        if old is not None:
            rows = rows.unionByName(old.where(F.col("bucket").isin(touched)).join(films.select("film_id"), "film_id", "left_anti"))
        filled = {r.bucket for r in rows.select("bucket").distinct().collect()}
        order = [c for c in ("bucket", "film_id", "name", "word") if c in rows.columns]
        ranged = rows.repartitionByRange(F.col("bucket"), F.col("film_id")).sortWithinPartitions(*order)
        ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
        for bucket in set(touched) - filled:  # nothing was written there, so what was there stays unless it is deleted
            delete(self.spark, f"{self.path}/{name}/bucket={bucket}")

    def _keyed(self, films: DataFrame) -> DataFrame:
        return films.withColumn("key", choice_key(self.rule_version, F.col("candidates"), F.col("runtime_minutes"), F.col("context")))

    def update(self, films: DataFrame, read: Step, fingerprint: Step, choose: Step) -> Updated:
        """Brings the cache up to date with `films`.

        read(files(film_id, name)) gives (film_id, name, bytes, word, count) of those files, with a row without a word
        for each file that could be read; fingerprint(words, sizes) a row a file (film_id, name, ...); choose(files), of
        films' candidates with their rank, fingerprint, runtime_minutes, context and further columns, a row a film
        (film_id, name, ...), without a name where no file will do.
        """
        old = self._table("choices")
        keyed = self._keyed(films)
        if old is not None:
            keyed = keyed.join(old.select("film_id", "key"), ["film_id", "key"], "left_anti")
        stale = self._kept(keyed, "stale")
        wanted = stale.select("*", F.posexplode("candidates").alias("rank", "name")).withColumn("rank", F.col("rank") + 1).drop("candidates", "key")
        prints = self._table("prints")
        fresh = wanted.select("film_id", "name").distinct()
        if prints is not None:
            fresh = fresh.join(prints.select("film_id", "name"), ["film_id", "name"], "left_anti")
        fresh = self._kept(fresh, "fresh")
        words = self._kept(read(fresh), "read")
        sizes = words.select("film_id", "name", "bytes").distinct()
        failed = self._kept(fresh.join(sizes, ["film_id", "name"], "left_anti").select("film_id").distinct(), "failed")
        new = self._kept(fingerprint(words.where("word IS NOT NULL").select("film_id", "name", "word", "count"), sizes), "prints")
        seen = fresh.select("film_id").distinct()
        known = new
        if prints is not None:
            known = new.unionByName(prints.drop("print_version", "bucket").join(stale.select("film_id"), "film_id", "left_semi"))
        chosen = choose(wanted.join(failed, "film_id", "left_anti").join(known, ["film_id", "name"]))
        chosen = self._kept(chosen.join(stale.select("film_id", "key"), "film_id"), "chosen")

        changed = chosen
        if old is not None:
            same = old.select("film_id", F.col("name").alias("_name"))
            changed = chosen.join(same, "film_id", "left").where("_name IS NULL OR NOT _name <=> name").drop("_name")
        changed = self._kept(changed.select("film_id", "name"), "changed")
        winners = changed.where("name IS NOT NULL")
        again = self._kept(winners.join(sizes, ["film_id", "name"], "left_anti"), "again")
        reread = self._kept(read(again), "reread")
        unread = again.join(reread.select("film_id", "name"), ["film_id", "name"], "left_anti").select("film_id").distinct()
        failed = self._kept(failed.unionAll(unread), "unread")
        counted = words.unionByName(reread).join(winners, ["film_id", "name"], "left_semi").where("word IS NOT NULL").select("film_id", "name", "word", "count")

        if prints is not None:
            new = new.unionByName(prints.drop("print_version", "bucket").join(seen, "film_id", "left_semi"))
        self._replace("prints", seen, self._kept(new, "all-prints"))
        done = chosen.join(failed, "film_id", "left_anti")
        self._replace("counts", changed.join(failed, "film_id", "left_anti"), counted.join(failed, "film_id", "left_anti"))
        self._replace("choices", done.select("film_id"), done)
        return Updated(done.count(), fresh.count(), again.count(), changed.count(), failed.count())

    def choices(self, films: DataFrame) -> DataFrame:
        """The choices of films whose key is the present one."""
        old = self._table("choices")
        if old is None:
            raise ValueError(f"{self.path}: nothing chosen yet")
        return old.join(self._keyed(films).select("film_id", "key"), ["film_id", "key"], "left_semi").drop("key", "print_version", "bucket")

    def counts(self, films: DataFrame) -> DataFrame:
        """(film_id, word, count) of the films' chosen files."""
        rows = self._table("counts").join(self.choices(films).select("film_id", "name"), ["film_id", "name"], "left_semi")
        return rows.select("film_id", "word", "count")

    def forget(self, films: DataFrame) -> None:
        """Takes films(film_id) out of all tables."""
        for name in ("choices", "counts", "prints"):
            rows = self._table(name)
            if rows is not None:
                self._replace(name, films, rows.limit(0).drop("print_version", "bucket"))
