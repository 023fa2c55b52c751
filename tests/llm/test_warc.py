import base64
import hashlib
import io

import pytest

from dialex.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_is_read_by_declared_length(version):
    records = [warc.ArcRecord("http://a.b/c d", "1.2.3.4", "19970102030405", "text/html", b"HTTP/1.0 200 OK\r\n\r\nline\n\nfiledesc://x 1 2 3 4\n", "200"), warc.ArcRecord("dns:x", "0.0.0.0", "1997", "text/dns", b"", "-")]
    got = list(warc.read_arc(io.BytesIO(warc.write_arc(records, version))))
    assert [(r.url, r.ip, r.date, r.mime, r.body, r.version) for r in got] == [(r.url, r.ip, r.date, r.mime, r.body, version) for r in records]


def test_bad_archives_are_errors():
    data = warc.write_arc([warc.ArcRecord("u", "i", "19970101", "m", b"body")], 1)
    for broken in (data[:-4], b"no archive\n", data.replace(b"1 0 dialex", b"9 0 dialex")):
        with pytest.raises(ValueError):
            list(warc.read_arc(io.BytesIO(broken)))


def test_conversion():
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npayload"
    r = warc.convert(warc.ArcRecord("http://u", "1.1.1.1", "19970102030405", "text/html", body))
    digest = base64.b32encode(hashlib.sha1(b"payload").digest()).decode()
    assert (r.headers["WARC-Type"], r.headers["WARC-Date"], r.headers["WARC-Payload-Digest"]) == ("response", "1997-01-02T03:04:05Z", f"sha1:{digest}")
    assert r.headers == warc.convert(warc.ArcRecord("http://u", "1.1.1.1", "19970102030405", "text/html", body)).headers
    again = warc.convert(warc.ArcRecord("http://v", "1.1.1.1", "1997", "text/html", body), "k", "row 1")
    assert (again.headers["WARC-Type"], again.payload, again.headers["WARC-Refers-To"]) == ("revisit", b"", warc.record_urn("row 1"))
    assert warc.convert(warc.ArcRecord("dns:x", "-", "1997", "text/dns", b"abc")).headers["WARC-Type"] == "resource"
    both = b"".join(warc.warc_bytes(x) for x in (r, again))
    assert [x.headers["WARC-Type"] for x in warc.read_warc(io.BytesIO(both))] == ["response", "revisit"]


def test_round_trip(spark, tmp_path):
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\n\n\nÜ" * 3
    rows = [(3, "http://a b/\n", tricky, "x", 1), (1, None, tricky, "x", 1), (2, "u", None, "x", 1), (5, "u", "", "x", 1), (7, "u", "only", "x", 1), (7, "u", "only", "x", 1), (None, "u", tricky, "x", 1)]
    warc.write_pages(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    expected = []
    for page, _, html, _, _ in rows:
        data = (html or "").encode()
        first = min((p for p, _, h, _, _ in rows if (h or "") == (html or "") and p is not None), default=None)
        expected.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page == first else "revisit", None if page == first else first))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(expected, key=str)
    assert len({r.record_id for r in got}) == len(rows)  # repeated rows and rows without an id have ids of their own


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_CLASSES", ((10, 3), (1000, 2), (1 << 62, 1)))
    rows = [(i, "u", "x" * [3, 500, 5000][i % 3] + str(i // 2)) for i in range(30)]
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    files = {k: len(list((tmp_path / "w" / f"class-{k}").glob("part-*"))) for k in range(3)}
    assert files == {0: 4, 1: 5, 2: 10}
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, len(h)) for i, _, h in rows]


def test_small_payloads_are_no_revisits_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write_pages(df, str(tmp_path / "w"), min_revisit_bytes=3)
    assert {r.page_id: r.record_type for r in warc.read_archives(spark, str(tmp_path / "w")).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    warc.write_pages(df.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
