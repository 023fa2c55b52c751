"""Zip archives near and far: the directory as a table, and members by one ranged read each.

A directory can only be read from its start, so one task streams each archive's, in bounded reads, and hands out rows of
(archive, name, sizes, method, offset). What is wanted is then chosen with ordinary DataFrame steps (a filter on names, an
anti-join with what is cached), and only that is fetched: members are dealt to tasks in runs of about equal bytes, in the
order they lie in, and each costs one read. Archives may lie on a web server that answers ranges, on a mounted disk, or
in any store that pyarrow opens by URI.
"""

from __future__ import annotations

import http.client
import struct
import time
import urllib.parse
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dialex.functions.text import film_id_from_path
from dialex.sources.scratch import scratch

# The zip format's signatures, record layouts and method numbers.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, ENTRY_SIZE, LOCAL_SIZE, FULL16, FULL32 = 22, 20, 46, 30, 0xFFFF, 0xFFFFFFFF
STORED, DEFLATED, UTF8_NAME = 0, 8, 0x800

#: Bytes of the directory held at a time; bytes read beyond a member for its own header, which may hold more than the
#: directory says; bytes of members in a task's batch; tries of a read, and the wait before the second.
CHUNK, SLACK, BATCH, TRIES, WAIT = 1 << 20, 1024, 16 << 20, 3, 0.2
#: Steps that the archives are divided into when members are dealt out, for each task.
FINE = 64

DIRECTORY = "archive string, name string, bytes long, packed long, method int, crc long, offset long"


class RangeIgnored(RuntimeError):
    """A web server sent a whole file where a part of it was asked for."""


class _Web:
    """Ranged reads over one kept connection."""

    def __init__(self, url: str, timeout: float = 120):
        self.url, self.timeout, self.parts, self.link = url, timeout, urllib.parse.urlsplit(url), None

    def _ask(self, start: int, end: str) -> tuple[bytes, str]:
        if self.link is None:
            kind = http.client.HTTPSConnection if self.parts.scheme == "https" else http.client.HTTPConnection
            self.link = kind(self.parts.netloc, timeout=self.timeout)
        target = urllib.parse.urlunsplit(("", "", self.parts.path or "/", self.parts.query, ""))
        self.link.request("GET", target, headers={"Range": f"bytes={start if start >= 0 else ''}-{end}"})
        answer = self.link.getresponse()
        if answer.status == 200:
            self.close()  # the whole file isn't waited for
            raise RangeIgnored(f"{self.url}: the server ignores ranges")
        body = answer.read()
        if answer.status != 206:
            raise OSError(f"{self.url}: status {answer.status}")
        return body, answer.headers.get("Content-Range", "")

    def tail(self, n: int) -> tuple[int, bytes]:
        """The size of the file and its last n bytes, or all of it if it is shorter."""
        body, said = self._ask(-1, str(n))
        return int(said.rpartition("/")[2]), body

    def read(self, start: int, n: int) -> bytes:
        return self._ask(start, str(start + n - 1))[0]

    def close(self) -> None:
        if self.link is not None:
            self.link.close()
            self.link = None


class _Store:
    """Positioned reads of a file by path or URI."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (fs.LocalFileSystem(), uri)
        self.file = store.open_input_file(path)

    def tail(self, n: int) -> tuple[int, bytes]:
        size = self.file.size()
        return size, self.read(max(0, size - n), min(n, size))

    def read(self, start: int, n: int) -> bytes:
        return self.file.read_at(n, start)

    def close(self) -> None:
        self.file.close()


def opened(archive: str) -> _Web | _Store:
    return _Web(archive) if archive.startswith(("http://", "https://")) else _Store(archive)


def _find_directory(source: _Web | _Store) -> tuple[int, int]:
    """(offset, size) of the directory. Bytes after the end record are let pass, as a comment is."""
    size, tail = source.tail(END_SIZE + LOCATOR_SIZE + FULL16)
    at = tail.rfind(END)
    if at < 0 or at + END_SIZE > len(tail):
        raise ValueError("not a zip archive, or one that is cut off")
    length, offset = struct.unpack_from("<II", tail, at + 12)
    if (length == FULL32 or offset == FULL32 or struct.unpack_from("<H", tail, at + 10)[0] == FULL16) and tail[at - LOCATOR_SIZE : at - LOCATOR_SIZE + 4] == LOCATOR64:
        record = source.read(struct.unpack_from("<Q", tail, at - LOCATOR_SIZE + 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("bad end record of a large archive")
        length, offset = struct.unpack_from("<QQ", record, 40)
    if offset + length > size:
        raise ValueError("the directory lies beyond the end of the archive")
    return offset, length


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset with those that don't fit 32 bits taken from the extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            more = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(more) if v == FULL32 else v for v in values]
        at += 4 + n
    return values


def entries(source: _Web | _Store) -> Iterator[tuple]:
    """(name, bytes, packed, method, crc, offset) of each member but folders, with a chunk of the directory in memory."""
    start, left = _find_directory(source)
    held = b""
    while True:
        need = ENTRY_SIZE if len(held) < ENTRY_SIZE else ENTRY_SIZE + sum(struct.unpack_from("<3H", held, 28))
        while len(held) < need and left:
            got = source.read(start, min(left, max(CHUNK, need - len(held))))
            if not got:
                break
            start, left, held = start + len(got), left - len(got), held + got
            need = max(need, ENTRY_SIZE if len(held) < ENTRY_SIZE else ENTRY_SIZE + sum(struct.unpack_from("<3H", held, 28)))
        if not held:
            return
        if len(held) < need or held[:4] != ENTRY:
            raise ValueError("bad entry in the directory")
        at = 0
        while len(held) - at >= ENTRY_SIZE:
            flags, method = struct.unpack_from("<2H", held, at + 8)
            crc, packed, size, n_name, n_extra, n_note = struct.unpack_from("<3I3H", held, at + 16)
            if held[at : at + 4] != ENTRY or len(held) - at < ENTRY_SIZE + n_name + n_extra + n_note:
                break
            name = held[at + ENTRY_SIZE : at + ENTRY_SIZE + n_name].decode("utf-8" if flags & UTF8_NAME else "cp437")
            extra = held[at + ENTRY_SIZE + n_name : at + ENTRY_SIZE + n_name + n_extra]
            size, packed, offset = _wide(extra, [size, packed, struct.unpack_from("<I", held, at + 42)[0]])
            if not name.endswith("/"):
                yield name, size, packed, method, crc, offset
            at += ENTRY_SIZE + n_name + n_extra + n_note
        held = held[at:]


def fetch(source: _Web | _Store, name: str, packed: int, method: int, crc: int, offset: int) -> bytes:
    """A member's content, by one read; by two where its own header holds far more than the directory's entry."""
    if method not in (STORED, DEFLATED):
        raise NotImplementedError(f"{name}: compression method {method}")
    blob = source.read(offset, LOCAL_SIZE + len(name.encode()) + SLACK + packed)
    if blob[:4] != LOCAL:
        raise ValueError(f"{name}: no member where the directory says")
    begin = LOCAL_SIZE + sum(struct.unpack_from("<2H", blob, 26))
    if begin + packed > len(blob):
        blob = source.read(offset, begin + packed)
    raw = blob[begin : begin + packed]
    content = raw if method == STORED else zlib.decompress(raw, -15)
    if zlib.crc32(content) != crc:
        raise ValueError(f"{name}: the content's checksum differs")
    return content


def _patient(source: _Web | _Store, member: tuple) -> tuple[bytes | None, str | None]:
    """(content, None) or (None, error): what fails every time is said in the row and fails no task. A server that
    ignores ranges does, as it would send the archive for each member."""
    for n in range(TRIES):
        try:
            return fetch(source, *member), None
        except RangeIgnored:
            raise
        except (OSError, http.client.HTTPException, ValueError, NotImplementedError, zlib.error) as e:
            error = f"{type(e).__name__}: {e}"
            if isinstance(e, NotImplementedError):
                break
            if isinstance(source, _Web):
                source.close()
            if n + 1 < TRIES:
                time.sleep(WAIT * 2**n)
    return None, error


class ZipDirectory(DataSource):
    """The members of zip archives without their contents; option `archives`: their places, a line each."""

    @classmethod
    def name(cls) -> str:
        return "zip_directory"

    def schema(self) -> str:
        return DIRECTORY

    def reader(self, schema) -> DataSourceReader:
        return _DirectoryReader([a for a in self.options["archives"].split("\n") if a])


class _DirectoryReader(DataSourceReader):
    def __init__(self, archives: list[str]):
        self.archives = archives

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(a) for a in self.archives]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        source = opened(partition.value)
        for entry in entries(source):
            yield partition.value, *entry
        source.close()


def zip_directory(spark: SparkSession, archives: str | list[str]) -> DataFrame:
    """(archive, name, bytes, packed, method, crc, offset) of all members of one or several archives; a task an archive."""
    spark.dataSource.register(ZipDirectory)
    places = [archives] if isinstance(archives, str) else archives
    return spark.read.format("zip_directory").option("archives", "\n".join(places)).load()


def dealt(members: DataFrame, tasks: int) -> DataFrame:
    """members with the number of the task that reads each: runs of about equal bytes in the order they lie in. The
    running sum goes over at most FINE steps a task and archive, not over members."""
    total = members.agg(F.sum("packed")).first()[0] or 0
    step = max(1, total // (tasks * FINE))
    at = F.floor(F.col("offset") / step)
    steps = members.groupBy("archive", at.alias("step")).agg(F.sum("packed").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("archive", "step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasked = steps.select("archive", "step", F.least(F.floor(before * tasks / F.lit(max(total, 1))).cast("int"), F.lit(tasks - 1)).alias("task"))
    return members.withColumn("step", at).join(F.broadcast(tasked), ["archive", "step"]).drop("step").repartitionById(tasks, F.col("task")).sortWithinPartitions("archive", "offset")


def _fetch_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    source, place, rows, held = None, None, [], 0
    for batch in batches:
        for m in batch.to_pylist():
            if m["archive"] != place:
                if source is not None:
                    source.close()
                source, place = opened(m["archive"]), m["archive"]
            content, error = _patient(source, (m["name"], m["packed"], m["method"], m["crc"], m["offset"]))
            rows.append({"archive": place, "name": m["name"], "bytes": m["bytes"], "content": content, "error": error})
            held += m["bytes"] if content is not None else 0
            if held >= BATCH or len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if source is not None:
        source.close()


def zip_contents(members: DataFrame, tasks: int | None = None) -> DataFrame:
    """(archive, name, bytes, content, error) of rows of `zip_directory`, read by `tasks` tasks (the session's shuffle
    partitions). A member that can't be read has no content and says why; a server that ignores ranges is an error."""
    spark = members.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = "archive string, name string, bytes long, content binary, error string"
    arrow = pa.schema([("archive", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
    path = scratch(spark, "members")  # what is wanted is looked at three times, and the directory should be read once
    members.select("archive", "name", "bytes", "packed", "method", "crc", "offset").write.parquet(path)
    rows = spark.read.schema(DIRECTORY).parquet(path)
    return dealt(rows, tasks).mapInArrow(partial(_fetch_batches, schema=arrow), out)


def zip_members(spark: SparkSession, path: str | list[str], partitions: int = 8, prefix: str = "", suffix: str = "", contents: bool = True) -> DataFrame:
    """(name, bytes, content) of the members whose names begin and end so; without contents, nothing but the directory
    is read. A member that can't be read is an error."""
    wanted = zip_directory(spark, path).where(F.col("name").startswith(prefix) & F.col("name").endswith(suffix))
    if not contents:
        return wanted.select("name", "bytes", F.lit(None).cast("binary").alias("content"))
    got = zip_contents(wanted, partitions)
    return got.select("name", "bytes", F.when(F.col("error").isNull(), F.col("content")).otherwise(F.raise_error(F.col("error")).cast("binary")).alias("content"))


def subtitle_files(members: DataFrame) -> DataFrame:
    """The members that are subtitle files of a film, with its film_id."""
    return members.withColumn("film_id", film_id_from_path(F.col("name"))).where("film_id IS NOT NULL")
