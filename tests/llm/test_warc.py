import base64
import hashlib

import pytest

from strideflow.llm.common import shared_path
from strideflow.llm.warc import read_archives, write_archives

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n"
PAGES = [
    (1, "http://a", "<p>one</p>"), (2, "http://b\r\nX: y", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", FAKE), (6, "u", "\r\n\r\n" + FAKE + FAKE),
    (7, "u", "x\r\n"), (8, "u", "é漢\r\n\r\n"), (9, "u", "WARC/1.0\r\n"), (10, "u", "y" * 40_000), (11, "u", FAKE), (None, "u", "<p>one</p>"), (12, "u", "\r"), (12, "u", "\r"),
    (13, "u", "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n"), (14, "u", "z" * 3000 + FAKE * 40),
]


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_round_trip(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = shared_path(spark, "warc-test")
        df = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, file string, at string").repartition(2)
        write_archives(df, path)
        got = read_archives(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(PAGES)
    first = {}
    for page, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0])):
        first.setdefault(html or "", page)
    for r in got:
        page = int(r["record_id"][10:-1]) if r["record_id"] else None
        html = next(h or "" for p, _, h in PAGES if p == page)
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert r["digest"] == f"sha1:{digest}" and r["payload_length"] == len(html.encode())
        if r["type"] == "revisit":
            assert bytes(r["payload"]) == b"" and r["refers_to"] == f"<urn:page:{first[html]}>" and page > first[html]
        else:
            assert bytes(r["payload"]) == html.encode() and (page is None or page == first[html])


def test_small_payloads_are_not_replaced(spark):
    path = shared_path(spark, "warc-test")
    write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string"), path, least_bytes=3)
    assert {r["type"] for r in read_archives(spark, path).collect()} == {"response"}


def test_empty(spark):
    path = shared_path(spark, "warc-test")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_archives(spark, path).collect() == []
