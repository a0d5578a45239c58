import gzip
import hashlib

import pytest

from stripewise.llm import warc
from stripewise.llm.shared import shared_path


@pytest.fixture(scope="module")
def pages(spark):
    long = "x" * 150 + "\r\n\r\nWARC/1.1\r\n" + "é大" * 40
    rows = [(5, "http://a\r\nX: y", long), (3, "http://b", long), (9, None, long), (1, "http://c", "short"), (2, "http://d", "short"), (4, "u", None), (6, "u", ""), (None, "u", long), (7, "u", "y" * 99), (8, "u", "y" * 99), (10, "u", "z" * 100), (11, "u", "z" * 100), (11, "u", "z" * 100)]
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id bigint, url string, html string, digest string")


def plain(rows):
    """What op4 returns, from the rows alone."""
    out, first = [], {}
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    seen = set()
    for i, h in rows:
        b = (h or "").encode()
        low = first.get(b)
        revisit = low is not None and (i != low or b in seen)
        if low is not None and i == low:
            seen.add(b)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", low if revisit else None))
    return sorted(out, key=str)


def test_odd_pages(spark, pages):
    a, b = shared_path(spark, "w"), shared_path(spark, "w")
    warc.write_archive(pages, a, per_file=3)
    assert warc.read_archive(spark, a).count() == 13
    warc.resolve_revisits(spark, a, b, per_file=4)
    got = [(None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in warc.resolved(spark, b).collect()]
    assert sorted(got, key=str) == plain([(r.page_id, r.html) for r in pages.collect()])
    heads = {r.record_id: r for r in warc.read_archive(spark, b).collect()}
    assert all(heads[r.refers_to].kind == "response" for r in heads.values() if r.kind == "revisit")
    assert {r.url for r in heads.values() if r.page_id == "5"} == {"http://a  X: y"}
    payloads = warc.read_archive(spark, b, payload=True).where("page_id = '3'").collect()
    assert payloads[0].payload.decode() == pages.where("page_id = 3").first().html


def test_empty_table(spark, pages):
    a, b = shared_path(spark, "w"), shared_path(spark, "w")
    warc.write_archive(pages.limit(0), a)
    warc.resolve_revisits(spark, a, b)
    assert warc.resolved(spark, b).count() == 0


def test_parser():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    got = list(warc.parsed(gzip.compress(one) + gzip.compress(one)))
    assert [b for _, b in got] == [b"ab\r\nc"] * 2 and got[0][0]["warc-type"] == "response"
    with pytest.raises(ValueError):
        list(warc.parsed(one[:-8]))
    with pytest.raises(ValueError):
        list(warc.parsed(b"HTTP/1.1\r\n"))


def test_query(spark, sf):
    got = sorted(map(str, warc.op4_warc_revisits(spark, sf).collect()))
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    from pyspark.sql import Row

    assert got == sorted(str(Row(page_id=a, payload_bytes=b, payload_digest=c, record_type=d, refers_to=e)) for a, b, c, d, e in plain(rows))


def test_sql_agrees_on_repeated_and_null_ids(spark, pages):
    import duckdb

    a, b = shared_path(spark, "w"), shared_path(spark, "w")
    warc.write_archive(pages, a)
    warc.resolve_revisits(spark, a, b)
    got = warc.resolved(spark, b).selectExpr("cast(page_id as bigint) page_id", "payload_bytes", "payload_digest", "record_type", "cast(refers_to as bigint) refers_to").collect()
    db = duckdb.connect()
    db.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, db.sql(warc.OP4_SQL).fetchall()))


def test_files_are_bounded_by_bytes(spark, pages, monkeypatch):
    assert warc.records_per_file(pages) == warc.PER_FILE and warc.records_per_file(pages.limit(0)) == warc.PER_FILE
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    assert 1 <= warc.records_per_file(pages) <= 20
