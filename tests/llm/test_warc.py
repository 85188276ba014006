"""WARC round trips and revisits."""

import base64
import hashlib

from llm import warc


def test_revisits(spark):
    nasty = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3
    rows = [(9, "http://a/", "same ü"), (3, "http://b/", "same ü"), (4, None, nasty), (5, "u\r\nX: 1", ""), (6, "u", None), (7, "u", nasty), (8, "u", "x" * 70_000), (8, "u", "x" * 70_000), (None, "n", "only"), (None, "n", "same ü")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for least in (0, 1, 10_000):
        want = []
        for i, _, html in rows:
            data = (html or "").encode()
            same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
            first = min(same, default=None)
            again = len(data) >= least and first is not None and i != first
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
        got = [tuple(r) for r in warc.resolve_revisits(pages, least_bytes=least).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.resolve_revisits(pages.limit(0)).count() == 0


def test_archive_holds_payloads_and_fresh_headers(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "héllo"), (2, "http://b/", "héllo"), (3, "http://c/", "other")], "page_id long, url string, html string")
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write_archive(warc.records(pages, "page_id", "url", "html"), first)
    warc.deduplicate(spark, first, second, "bigint")
    rows = {r.source_id: r for r in warc.read_archive(spark, second).collect()}
    assert rows["1"].payload == "héllo" and rows["3"].payload == "other" and rows["2"].payload is None
    assert rows["2"].refers_to_id == rows["1"].record_id and rows["2"].url == "http://b/"
    old = {r.record_id for r in warc.read_archive(spark, first).collect()}
    assert len(old) == 3 and not old & {r.record_id for r in rows.values()}
