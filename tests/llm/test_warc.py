import hashlib
from collections import Counter

import duckdb

from parlance.llm import warc as op
from parlance.llm.common import fresh_path

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:parlance:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
BIG = "<p>equal payload</p>" * 10
PAGES = [
    (1, "http://a", BIG), (2, "http://b", BIG), (3, None, BIG), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u\r\nWARC-Type: x", "x" + FAKE + "y"), (9, "u", FAKE), (10, "u", FAKE * 3), (None, "u", BIG), (None, "u", "alone é日本"),
    (11, "u", "WARC/1.1\r\n"), (12, "u", "WARC/1.1\r\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\n"), (13, "u", "z" * 300_000 + FAKE + "z" * 300_000), (14, "u", "\r\n\r\n"), (15, "u", "tail\r\n\r\n"), (6, "u", "short"), (16, "u", "é" * 120 + MAGIC if (MAGIC := op.MAGIC) else ""),
]


def brute(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        to = first.get(html) if first.get(html) != i else None
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to, True))
    return Counter(out)


def read(spark, rows, files=1):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").coalesce(files)
    path = fresh_path(spark, "warc-test")
    op.write_archives(df, path)
    return Counter(tuple(r) for r in op.pages_of(op.read_archives(spark, path)).collect())


def test_round_trip(spark, monkeypatch):
    assert read(spark, PAGES) == brute(PAGES)
    monkeypatch.setattr(op, "BROADCAST_PIECES", 0)
    assert read(spark, PAGES, 3) == brute(PAGES)


def test_small_blocks(spark):
    """Blocks far smaller than records: offsets are put together from many tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = PAGES + [(100 + k, "u", f"page {k} " * (k % 50) + (FAKE if k % 7 == 0 else "")) for k in range(300)]
        assert read(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def says(length, more=""):
    return f"WARC/1.1\r\nWARC-Type: response\r\n{more}Content-Length: {length}\r\n\r\nabc\r\n\r\n"


LENGTHS = ["99999999999999999999", "9223372036854775807", "9223372036854775000", "9" * 5000, "999999999999999", "000000000000000003", "-3", "+3", "3.0", "0x3", " ", "", "\u0663", "1_0", "3\t", "NaN"]


def test_lengths_of_any_form_in_payloads(spark):
    rows = [(k, "u", f"page {k} " + says(x) * (1 + k % 2)) for k, x in enumerate(LENGTHS)] + [(100 + k, "u", says(x)) for k, x in enumerate(LENGTHS)]
    rows += [(200, "u", says("3")[:-9]), (201, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3"), (202, "u", says("3", "no colon\r\n")), (203, "u", says("3", "Content-Length: 9223372036854775807\r\n")), (204, "u", "WARC/1.1\r\n" * 40), (205, "u", "plain")]
    assert read(spark, rows) == brute(rows)
    assert read(spark, rows, 3) == brute(rows)


def test_empty(spark):
    assert read(spark, []) == Counter()


def test_sql(spark, sf_dir):
    want = duckdb.connect().execute(op.SQL.replace("FROM pages", f"FROM '{sf_dir}/pages.parquet'")).fetchall()
    assert Counter(map(tuple, op.query(spark, sf_dir).collect())) == Counter(want)
