"""Documents by key: one is read without a scan of the others.

A store is a Parquet table in folders by a hash of the key, sorted by key within a file, in small pages with a bloom filter
on the key. A look-up names the folder, so all others are pruned when the query is planned; within it, the sort order and
the filter leave a page or two. A file for each of millions of keys, which this replaces, would only burden a store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.sources.scratch import exists

SCHEMA = "key string, payload string, bucket int"
PAGE_ROWS, BLOOM_BITS = 200, 1 << 20


class PayloadStore:
    """Payloads (text, such as JSON) by key in a folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame) -> None:
        """Replaces the store by rows(key, payload); rows without a key are left out, and keys should come once."""
        keyed = rows.where("key IS NOT NULL").select(F.col("key").cast("string").alias("key"), "payload").withColumn("bucket", self.bucket(F.col("key")))
        out = keyed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket")
        for name, value in (("parquet.page.row.count.limit", PAGE_ROWS), ("parquet.bloom.filter.enabled#key", "true"), ("parquet.bloom.filter.max.bytes", BLOOM_BITS // 8)):
            out = out.option(name, value)
        out.parquet(self.path)

    def rows(self) -> DataFrame:
        """(key, payload, bucket); nothing where no store was written, as an optional one may be missing altogether."""
        return self.spark.read.schema(SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], SCHEMA)

    def get(self, *keys: str) -> DataFrame:
        """(key, payload) of these keys; absent ones have no row. The plan reads these keys' folders only."""
        asked = [F.lit(str(k)) for k in keys]
        return self.rows().where(F.col("bucket").isin([self.bucket(k) for k in asked]) & F.col("key").isin(asked)).select("key", "payload")

    def look_up(self, keys: DataFrame, **beside: PayloadStore) -> DataFrame:
        """(key, payload, and a column for each store beside): a row for each of keys(key), null where a store has none."""
        out = keys.select(F.col("key").cast("string").alias("key"))
        for name, store in {"payload": self, **beside}.items():
            own = store.rows().select("key", "bucket", F.col("payload").alias(name))
            out = out.withColumn("bucket", store.bucket(F.col("key"))).join(own, ["key", "bucket"], "left").drop("bucket")
        return out

    def one(self, key: str, **beside: PayloadStore) -> dict | None:
        """The payloads of a key by store, null where a store beside lacks it; None where this store does."""
        found = self.get(key).withColumnRenamed("payload", "payload")
        for name, store in beside.items():
            found = found.join(store.get(key).select("key", F.col("payload").alias(name)), "key", "left")
        row = found.first()
        return row.asDict() if row else None


class BakedSlices:
    """Results baked once for all films and once for each language, and the way a request takes through them."""

    ALL = "all"

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{name}"

    def write(self, rows: DataFrame) -> None:
        """Replaces the table by rows with a column `slice`: `all`, or the code of a language."""
        rows.repartitionByRange("slice").write.mode("overwrite").partitionBy("slice").parquet(self.path)

    def part(self, code: str) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("slice") == code).drop("slice")

    def ask(self, langs: Iterable[str], merge: Callable[[list[DataFrame]], DataFrame]) -> DataFrame:
        """No language: the global result. One: its own, exact. Several: the results of each, merged. Chinese stands for
        both of its codes."""
        codes = list(dict.fromkeys("zh" if c == "cn" else c for c in langs))
        parts = [self.part(c) for c in codes or [self.ALL]]
        return parts[0] if len(parts) == 1 else merge(parts)
