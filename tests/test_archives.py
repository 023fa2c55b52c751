"""Zip archives on a disk and on a web server that counts what it is asked."""

import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from dialex.sources import archives


class Server:
    """Serves the files of a folder; `ranges` may be turned off, and `failures` makes so many requests fail first."""

    def __init__(self, folder):
        self.folder, self.asked, self.ranges, self.failures = folder, [], True, 0
        outer = self

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def do_GET(self):  # noqa: N802
                data = (outer.folder / self.path.lstrip("/")).read_bytes()
                said = self.headers.get("Range", "")
                outer.asked.append(said)
                if outer.failures:
                    outer.failures -= 1
                    self.send_response(503)
                    self.send_header("Content-Length", "0")
                    self.end_headers()
                    return
                if outer.ranges and said:
                    first, _, last = said.removeprefix("bytes=").partition("-")
                    a = int(first) if first else max(0, len(data) - int(last))
                    part = data[a : int(last) + 1] if first else data[a:]
                    self.send_response(206)
                    self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(data)}")
                else:
                    part = data
                    self.send_response(200)
                self.send_header("Content-Length", str(len(part)))
                self.end_headers()
                self.wfile.write(part)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def url(self, name):
        return f"http://127.0.0.1:{self.server.server_port}/{name}"


@pytest.fixture
def server(tmp_path):
    s = Server(tmp_path)
    yield s
    s.server.shutdown()


def member(i):
    return f"<document><s>line {i}</s>{'x' * (i * 37 % 3000)}</document>".encode()


def write(path, n=40, comment=b"", long_extra=False):
    with zipfile.ZipFile(path, "w") as z:
        for i in range(n):
            info = zipfile.ZipInfo(f"OpenSubtitles/raw/en/1999/{i}/1.xml")
            info.compress_type = zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED
            if long_extra:
                info.extra = b"\xfe\xca" + (1500).to_bytes(2, "little") + b"e" * 1500
            z.writestr(info, member(i))
        z.writestr("OpenSubtitles/raw/en/1999/", b"")
        z.writestr("README é", b"no film")
        z.comment = comment


def test_members_on_a_disk(spark, tmp_path):
    write(tmp_path / "c.zip", comment=b"a comment")
    for place in (str(tmp_path / "c.zip"), f"file://{tmp_path}/c.zip"):
        got = archives.subtitle_files(archives.zip_members(spark, place, partitions=3)).collect()
        assert {(r.film_id, bytes(r.content), r.bytes) for r in got} == {(f"tt{i:07d}", member(i), len(member(i))) for i in range(40)}
    names = archives.zip_members(spark, str(tmp_path / "c.zip"), suffix=" é", contents=False).collect()
    assert [(r.name, r.bytes, r.content) for r in names] == [("README é", 7, None)]


def test_one_read_for_each_member_wanted(spark, server, tmp_path):
    write(tmp_path / "c.zip")
    directory = archives.zip_directory(spark, server.url("c.zip"))
    wanted = directory.where(F.col("name").rlike(r"/1?[05]/1\.xml$"))
    contents = archives.zip_contents(wanted, 3)
    assert len(server.asked) == 2  # the end of the archive, and the directory
    server.asked.clear()
    got = contents.collect()
    assert {bytes(r.content) for r in got} == {member(i) for i in (0, 5, 10, 15)} and all(r.error is None for r in got)
    assert len(server.asked) == 4
    sizes = {int(b) - int(a) + 1 for a, b in (s.removeprefix("bytes=").split("-") for s in server.asked)}
    assert max(sizes) < 3000 + archives.SLACK + 200


def test_directory_in_small_reads(tmp_path, monkeypatch):
    write(tmp_path / "c.zip")
    want = list(archives.entries(archives.opened(str(tmp_path / "c.zip"))))
    assert len(want) == 41
    for n in (1, 7, 50, 200):
        monkeypatch.setattr(archives, "CHUNK", n)
        assert list(archives.entries(archives.opened(str(tmp_path / "c.zip")))) == want


def test_large_header_costs_a_second_read(spark, server, tmp_path, monkeypatch):
    write(tmp_path / "c.zip", 4, long_extra=True)
    source = archives.opened(server.url("c.zip"))
    entries = list(archives.entries(source))
    server.asked.clear()
    stored = [e for e in entries if e[0].endswith("/0/1.xml")][0]
    name, _, packed, method, crc, offset = stored
    assert archives.fetch(source, name, packed, method, crc, offset) == member(0)
    assert len(server.asked) == 2


def test_archive_with_wide_numbers(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 500)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    write(tmp_path / "c.zip", 20)
    source = archives.opened(str(tmp_path / "c.zip"))
    got = {name: archives.fetch(source, name, *rest) for name, _, *rest in archives.entries(source)}
    assert got["OpenSubtitles/raw/en/1999/19/1.xml"] == member(19) and len(got) == 21


def test_server_without_ranges_is_an_error(spark, server, tmp_path):
    write(tmp_path / "c.zip", 3)
    rows = archives.zip_directory(spark, server.url("c.zip")).collect()
    server.ranges = False
    with pytest.raises(Exception, match="ignores ranges"):
        archives.zip_directory(spark, server.url("c.zip")).collect()
    with pytest.raises(Exception, match="ignores ranges"):
        archives.zip_contents(spark.createDataFrame(rows, archives.DIRECTORY), 1).collect()


def test_what_fails_is_tried_again_and_then_said(spark, server, tmp_path, monkeypatch):
    write(tmp_path / "c.zip", 3)
    rows = archives.zip_directory(spark, server.url("c.zip")).where(F.col("name").endswith(".xml")).collect()
    server.failures = 2
    assert all(r.error is None for r in archives.zip_contents(spark.createDataFrame(rows, archives.DIRECTORY), 1).collect())
    broken = bytearray((tmp_path / "c.zip").read_bytes())
    broken[broken.index(member(0)) + 5] ^= 255
    (tmp_path / "c.zip").write_bytes(bytes(broken))
    odd = [r.asDict() | ({"method": 12} if r.name.endswith("/2/1.xml") else {}) for r in rows]
    got = {r.name: r for r in archives.zip_contents(spark.createDataFrame(odd, archives.DIRECTORY), 2).collect()}
    assert "checksum" in got[rows[0].name].error and got[rows[0].name].content is None
    assert "method 12" in got[rows[2].name].error and bytes(got[rows[1].name].content) == member(1)
    with pytest.raises(Exception, match="checksum"):
        archives.zip_members(spark, server.url("c.zip")).collect()
    with pytest.raises(Exception, match="not a zip archive"):
        (tmp_path / "d.zip").write_bytes(b"nothing of the kind" * 10)
        archives.zip_directory(spark, str(tmp_path / "d.zip")).collect()


def test_members_are_dealt_by_bytes_in_the_order_they_lie_in(spark, tmp_path):
    sizes = [10] * 50 + [5000] + [10] * 50 + [400] * 30
    rows, at = [], 0
    for i, n in enumerate(sizes):
        rows.append(("a", f"m{i}", n, n, 0, 0, at))
        at += n
    got = archives.dealt(spark.createDataFrame(rows, archives.DIRECTORY), 4).withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == len(sizes) and all(r.part == r.task for r in got)
    load = {t: sum(r.packed for r in got if r.task == t) for t in range(4)}
    assert max(load.values()) <= sum(sizes) / 4 + 5000
    order = sorted(got, key=lambda r: r.offset)
    assert [r.task for r in order] == sorted(r.task for r in order)
    assert archives.dealt(spark.createDataFrame([], archives.DIRECTORY), 4).count() == 0
