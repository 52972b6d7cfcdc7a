import gzip
import hashlib

import pytest

from storefront.llm import archives
from storefront.llm.archives import (
    arc_bytes,
    archive_round_trip,
    convert_archives,
    inflated,
    iso_date,
    read_arc,
    read_warc,
    to_warc,
    warc_bytes,
)

LONG = "<p>" + "é" * 800 + "</p>"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_by_version_and_declared_length(version):
    payloads = [("http://a.test/x y", b"one\n\n2 0 x\nURL-like line 5\n"), (None, b""), ("http://b.test/", bytes(range(256)))]
    found = list(read_arc(arc_bytes(version, payloads)))
    assert [r.payload for r in found] == [p for _, p in payloads] and {r.version for r in found} == {version}
    assert found[0].fields["url"] == "http://a.test/x%20y" and found[1].fields["url"] == "-"
    assert ("checksum" in found[0].fields) == (version == 2)


def test_broken_arc():
    data = arc_bytes(1, [("http://a.test/", b"payload")])
    for broken in (data[:-5], data.replace(b"1 0 store", b"7 0 store"), data.replace(b" 0.0.0.0 2001", b" 2001", 2).replace(b"html 7", b"html 7")):
        with pytest.raises(ValueError):
            list(read_arc(broken))


def test_warc_round_trip():
    records = list(read_arc(arc_bytes(2, [("http://a.test/", b"WARC/1.0\r\n\r\n\r\n\r\n"), ("http://b.test/", b"")])))
    made = [to_warc(records[0], 1, None), to_warc(records[1], 2, None), to_warc(records[0], 3, 1)]
    data = b"".join(map(warc_bytes, made))
    back = list(read_warc(data))
    assert [(r.headers, r.payload) for r in back] == [(r.headers, r.payload) for r in made]
    assert back[2].headers["WARC-Refers-To"] == back[0].headers["WARC-Record-ID"] and back[2].payload == b""
    assert iso_date("19970102") == "1997-01-02T00:00:00Z" and iso_date("20200304050607") == "2020-03-04T05:06:07Z"
    with pytest.raises(ValueError):
        list(read_warc(data[:-2]))


def test_pages(spark):
    rows = [(1, "u", LONG), (9, "u", LONG), (4, None, LONG), (5, "v", "short"), (6, "v", "short"), (7, "", None), (8, "x y\n", ""), (2, "z", "\r\n\r\n" + "x" * 200_000)]
    rows = [(*r, "extra") for r in rows] + [(None, "u", LONG, None), (2, "z", rows[-1][2], "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    got = archive_round_trip(pages).collect()
    assert len(got) == len(rows)
    for page, _, html, _ in rows:
        data = (html or "").encode()
        own = [r for r in got if r["page_id"] == page]
        assert all((r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest()) for r in own)
        want = ("revisit", 9) if page in (None, 1, 4) else ("response", None)
        assert all((r["record_type"], r["refers_to"]) == want for r in own)
    assert archive_round_trip(pages.limit(0)).count() == 0


def test_gzip_members_and_pieces(monkeypatch):
    records = [to_warc(r, n, None) for n, r in enumerate(read_arc(arc_bytes(1, [(f"http://a.test/{n}", bytes([n]) * 5000) for n in range(9)])))]
    members = b"".join(gzip.compress(warc_bytes(r)) for r in records)
    for size in (7, 1000, 1 << 22):
        monkeypatch.setattr(archives, "INFLATED", size)
        assert [r.payload for r in read_warc(inflated(members + b"\0\0"))] == [r.payload for r in records]
    with pytest.raises(ValueError):
        list(inflated(members[:-3]))


def _arc(version, records):
    """A file of foreign make: ``records`` are (line without length, payload)."""
    block = f"{version} 0 crawler\n{archives.FIELDS[version]}\n".encode()
    out = b"filedesc://x.arc 0.0.0.0 19970102030405 text/plain " + (b"200 - - 0 x.arc " if version == 2 else b"") + str(len(block)).encode() + b"\n" + block
    return out + b"".join(b"\n" + line.encode() + b" " + str(len(p)).encode() + b"\n" + p for line, p in records) + b"\n"


def test_archives_of_a_crawl(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\xff\xfe body</p>"
    one = _arc(1, [
        ("http://a.test/x y 1.2.3.4 19970102030405 text/html", page),
        ("dns:a.test 1.2.3.4 19970102030406 text/dns", b"a.test 1.2.3.4"),
        ("broken line without fields", b""),
        ("http://a.test/2 1.2.3.4 19970102 text/plain", bytes(range(256))),
    ])
    two = _arc(2, [("http://b.test/ 1.2.3.4 20200101000000 text/html 200 - - 77 x.arc", page)])
    cut_short = _arc(1, [("http://c.test/ 1.2.3.4 19970102030405 text/html", b"whole"), ("http://c.test/2 1.2.3.4 19970102030405 text/html", b"y" * 50)])[:-20]
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "one.arc").write_bytes(one)
    (folder / "two.arc.gz").write_bytes(gzip.compress(two[:150]) + gzip.compress(two[150:]))
    (folder / "three.arc").write_bytes(cut_short)
    (folder / "four.arc.gz").write_bytes(gzip.compress(two)[:-9])
    (folder / "other.txt").write_bytes(b"no archive")
    out = str(tmp_path / "warc")
    rows = {(r["file"], r["place"]): r for r in convert_archives(spark, str(folder), out).collect()}
    body = page.split(b"\r\n\r\n", 1)[1]
    for key in (("one.arc", 0), ("two.arc.gz", 0)):
        assert (rows[key]["record_type"], rows[key]["payload_bytes"]) == ("response", len(body))
        assert rows[key]["payload_digest"] == hashlib.sha1(body).hexdigest()
    assert rows["one.arc", 0]["url"] == "http://a.test/x y" and rows["one.arc", 1]["record_type"] == "resource"
    assert "no date" in rows["one.arc", 2]["error"]
    assert rows["one.arc", 3]["payload_bytes"] == 256
    assert rows["three.arc", 0]["error"] is None and "declares 50 bytes" in rows["three.arc", 1]["error"]
    assert "cut short" in rows["four.arc.gz", None]["error"] and len(rows) == 8
    data = b"".join(b"".join(inflated(f.read_bytes())) for f in sorted((tmp_path / "warc").glob("*.gz")))
    back = list(read_warc(data))
    assert sorted(r.payload for r in back) == sorted([page, page, b"a.test 1.2.3.4", bytes(range(256)), b"whole"])
    by_uri = {r.headers["WARC-Target-URI"]: r.headers for r in back}
    assert by_uri["http://a.test/x%20y"]["WARC-Date"] == "1997-01-02T03:04:05Z"
    assert by_uri["http://a.test/2"]["WARC-Date"] == "1997-01-02T00:00:00Z" and by_uri["dns:a.test"]["WARC-Type"] == "resource"
    assert len({r.headers["WARC-Record-ID"] for r in back}) == 5


def test_no_archives(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert convert_archives(spark, str(tmp_path / "none"), str(tmp_path / "out")).count() == 0
