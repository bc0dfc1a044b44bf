import gzip
import hashlib
import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from splitscope.llm import warc
from tests.llm.conftest import CLASHING

LONG = "<p>größer als tausend Bytes</p>" * 60
ROWS = [
    (1, "http://a.example/1", LONG),
    (2, "http://a.example/2", LONG),
    (9, "http://a.example/ü?q= x\r\nInjected: yes", LONG),
    (3, None, None),
    (4, "http://b.example/", "short"),
    (5, "http://b.example/", "short"),
    (6, "http://c.example/", "x" * 999),
    (7, "http://c.example/", "x" * 999),
    (8, "http://c.example/", "y" * 1000),
    (10, "http://c.example/", "y" * 1000),
    (None, "http://d.example/", LONG),
    (11, "http://e.example/", "z\r\n\r\nz" * 300),
    (11, "http://e.example/", "z\r\n\r\nz" * 300),
    (12, "http://e.example/", "w" * 3_000_000),
    (None, None, "only without ids " * 100),
    (None, None, "only without ids " * 100),
]


def expected(rows):
    last, copies = {}, {}
    for i, _, h in rows:
        copies[h] = copies.get(h, 0) + 1
        if i is not None:
            last[h] = max(last.get(h, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = last.get(h) if len(b) >= 1000 and copies[h] > 1 and (i is None or i < last.get(h, i)) else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return out


key = lambda r: tuple(str(x) for x in r)


@pytest.fixture
def pages(spark):
    def make(rows, tasks=3):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(tasks)
        return df.withColumns({k: F.lit(v) for k, v in {**CLASHING, "payload": "p", "last": 1, "offset": 2, "refers_to": 5, "copies": 3}.items()})

    return make


def test_round_trip_of_odd_pages(pages):
    got = [tuple(r) for r in warc.archive_round_trip(pages(ROWS)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=key) == sorted(expected(ROWS), key=key)


def test_round_trip_equals_its_sql(spark, pages):
    rows = [r for r in ROWS if r[0] is not None]
    con = duckdb.connect()
    con.register("pages", __import__("pandas").DataFrame(rows, columns=["page_id", "url", "html"]))
    want = con.execute(warc.SQL).fetchall()
    assert sorted([(*r[:4], r[4]) for r in want], key=key) == sorted(expected(rows), key=key)


def test_round_trip_of_no_pages(pages):
    assert warc.archive_round_trip(pages(ROWS).limit(0)).collect() == []


def records_of(path):
    """The records of an archive, read from its first byte to its last."""
    data, at = gzip.open(path).read(), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:] if x)
        size = int(fields["Content-Length"])
        assert data.startswith(b"WARC/1.1\r\n", at) and data[end + size : end + size + 4] == b"\r\n\r\n"
        yield fields, data[end : end + size]
        at = end + size + 4


def test_archives_are_read_in_order_too(pages):
    folder = "file://" + tempfile.mkdtemp(prefix="warc-")
    index = warc.write_archives(pages(ROWS), folder, archive_bytes=500, date="2026-01-01T00:00:00Z").collect()
    names = {r["archive"] for r in index}
    assert len(names) > 3
    found = [x for n in names for x in records_of(f"{folder[7:]}/{n}")]
    assert len(found) == len(ROWS)
    by_id = {f["WARC-Record-ID"]: f for f, _ in found if f["WARC-Type"] == "response"}
    for fields, block in found:
        assert "Injected" not in fields and fields["WARC-Date"] == "2026-01-01T00:00:00Z"
        if fields["WARC-Type"] == "revisit":
            assert by_id[fields["WARC-Refers-To"]]["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
            assert block.endswith(b"\r\n\r\n") and fields["WARC-Profile"].endswith("identical-payload-digest")
        else:
            assert hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest() == fields["WARC-Payload-Digest"][5:]
    for n in names:  # the index covers each archive without gap
        spans = sorted((r["offset"], r["length"]) for r in index if r["archive"] == n)
        assert [o for o, _ in spans] == [sum(x for _, x in spans[:i]) for i in range(len(spans))]
        assert sum(x for _, x in spans) == os.path.getsize(f"{folder[7:]}/{n}")


def test_selected_records_and_their_payloads(spark, pages):
    folder = "file://" + tempfile.mkdtemp(prefix="warc-")
    index = warc.write_archives(pages(ROWS), folder)
    some = index.where("page_id in (1, 4, 12)")
    got = {r["page_id"]: r for r in warc.read_records(some, folder).collect()}
    assert set(got) == {1, 4, 12} and got[1]["payload"] is None and bytes(got[4]["payload"]) == b"short" and len(got[12]["payload"]) == 3_000_000
    assert got[4]["url"] == "http://b.example/"
    whole = {r["page_id"]: bytes(r["payload"]) for r in warc.with_payloads(some, folder).collect()}
    assert whole == {1: LONG.encode(), 4: b"short", 12: b"w" * 3_000_000}
    assert warc.read_records(index.where("page_id = 999"), folder).collect() == []


def test_ranges_are_coalesced():
    ranges = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 500, 10), ("b", 0, 90), ("b", 90, 20), ("b", 110, 300)]
    assert list(warc.coalesced(ranges, gap=5, most=100)) == [
        ("a", 0, 30, [(0, 10), (10, 10), (25, 5)]), ("a", 500, 510, [(500, 10)]), ("b", 0, 90, [(0, 90)]), ("b", 90, 110, [(90, 20)]), ("b", 110, 410, [(110, 300)]),
    ]


def test_damage_is_noticed():
    raw = warc.record(1, "http://a/", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "2026-01-01T00:00:00Z")
    assert warc.parsed(raw)[:2] == (1, "http://a/")
    for bad in (raw.replace(b"payload", b"paylaod"), raw[:-4], raw + b"x"):
        with pytest.raises(ValueError):
            warc.parsed(bad)
