"""WARC archives: writing, reading back, and resolving revisits.

Archives are written with Spark's text writer: a record is one value (header, blank line, block) and the two
line ends that close a record are the separator between values. So they go to any file system that Spark can write, under its commit
protocol; a lost executor leaves no half file. Records are read back by their Content-Length.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path, stored, table

# Fixed values of the format.
END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always kept as responses.
LEAST = 100
#: Records and payload bytes (on average) of one archive file: bound what a task reads at once.
PER_FILE = 10_000
FILE_BYTES = 256 << 20
#: Payload bytes of a batch that a reader hands on.
BATCH = 8 << 20


def _line(name: str, value: Column) -> Column:
    """A header line, nothing where the value is null; line ends in a value become blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.translate(value.cast("string"), "\r\n", "  "), F.lit("\r\n")), F.lit(""))


def _record(kind: Column, own: dict[str, Column], payload: Column) -> Column:
    """A record as a string: response with its payload, or revisit with the HTTP header only."""
    size = F.octet_length(payload)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), own["bytes"].cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(kind == "response", size).otherwise(0)
    head = [
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), own["record_id"], F.lit(">\r\n")),
        _line("WARC-Date", own["date"]),
        _line("WARC-Target-URI", own["url"]),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), own["digest"])),
        _line("Page-ID", own["page_id"]),
    ]
    if "refers_to" in own:
        head += [
            _line("WARC-Profile", F.when(kind == "revisit", F.lit(REVISIT))),
            _line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), own["refers_to"], F.lit(">"))),
            _line("WARC-Refers-To-Target-URI", own["refers_url"]),
            _line("WARC-Refers-To-Date", own["refers_date"]),
        ]
    head += [F.lit("Content-Type: application/http; msgtype=response\r\n"), F.concat(F.lit("Content-Length: "), length.cast("string"), F.lit(END)), http]
    return F.concat(*head, F.when(kind == "response", payload.cast("string")).otherwise(F.lit("")))


def _written(records: DataFrame, path: str, per_file: int) -> None:
    records.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)


def records_per_file(pages: DataFrame, html_col: str = "html") -> int:
    """PER_FILE, or as many as have FILE_BYTES where payloads are large."""
    mean = pages.agg(F.avg(F.octet_length(F.col(html_col).cast("string")))).first()[0] or 1
    return max(1, min(PER_FILE, int(FILE_BYTES / mean)))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", per_file: int = PER_FILE) -> None:
    """One response record for each row of pages, payload the html in UTF-8 (null: empty), in gzipped files below path.

    Rows with null or equal ids get records of their own, told apart by their record ids. A null url has no
    header line. Other columns are not looked at. Without rows there is an archive without records."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.uuid().alias("record_id"))
    own = {c: F.col(c) for c in ("page_id", "url", "record_id")} | {"date": F.lit(date), "digest": F.sha2("payload", 256), "bytes": F.octet_length("payload")}
    _written(rows.select(_record(F.lit("response"), own, F.col("payload"))), path, per_file)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive file, gzipped or plain."""
    stream = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts here: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield fields, block


_FIELDS = "record_id string, page_id string, kind string, url string, date string, digest string, bytes bigint, refers_to string"


def _reader(with_payload: bool):
    names = [x.split()[0] for x in _FIELDS.split(", ")] + ["payload"] * with_payload

    def bare(x: str | None) -> str | None:
        return x.strip("<>").removeprefix("urn:uuid:") if x else None

    def out(rows):
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string()] + [pa.binary()] * with_payload
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for data in batch.column(0):
                for fields, block in parsed(data.as_py()):
                    kind = fields["warc-type"]
                    payload = block.partition(END.encode())[2]
                    response = kind == "response"
                    digest = hashlib.sha256(payload).hexdigest() if response else fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    rows.append((bare(fields["warc-record-id"]), fields.get("page-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), digest, len(payload) if response else None, bare(fields.get("warc-refers-to")), *([payload] if with_payload else [])))
                    size += len(payload) + 200
                    if size > BATCH:
                        yield out(rows)
                        rows, size = [], 0
        if rows:
            yield out(rows)

    return run


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records below path (none where it has no records): record_id, page_id, kind, url, date, digest, bytes, refers_to and, if asked for, payload.
    Digest and size of responses are those of the bytes read; a revisit has the digest of its header and no size."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_reader(payload), _FIELDS + (", payload binary" if payload else ""))


def resolve_revisits(spark: SparkSession, source: str, target: str, least: int = LEAST, per_file: int = PER_FILE, id_type: str = "bigint") -> None:
    """Write the archive at source again at target: of responses with equal payloads of at least ``least`` bytes
    the one with the smallest page id (nulls last; then by record id) stays, others become revisit records that refer to it.

    An archive without records gives another one. Only headers are shuffled by digest, combined before: a digest that a third of all records share is one
    row of a task. Payloads move at most once, with the decision on their record."""
    heads = read_archive(spark, source).where("kind = 'response'")
    order = F.struct(F.col("page_id").isNull(), F.col("page_id").cast(id_type), F.col("record_id"), F.col("url"), F.col("date"))
    first = heads.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n > 1")
    # stored, so that its size is known when the join is planned: payloads stay where they are unless it is too large to broadcast
    named = stored(first.select("digest", "bytes", F.col("o.record_id").alias("refers_to"), F.col("o.url").alias("refers_url"), F.col("o.date").alias("refers_date")), "originals")
    rows = read_archive(spark, source, payload=True).drop("refers_to").join(named, ["digest", "bytes"], "left")
    revisit = F.col("refers_to").isNotNull() & (F.col("refers_to") != F.col("record_id"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    own = {c: F.col(c) for c in ("record_id", "page_id", "url", "date", "digest", "bytes")} | {c: F.when(revisit, F.col(c)) for c in ("refers_to", "refers_url", "refers_date")}
    _written(rows.select(_record(kind, own, F.col("payload"))), target, per_file)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of a deduplicated archive, revisits with what their response has: page_id, payload_bytes,
    payload_digest, record_type, refers_to (the page id of the response)."""
    heads = read_archive(spark, path)
    responses = heads.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to"), F.col("bytes").alias("to_bytes"))
    revisits = heads.where("kind = 'revisit'").join(responses, "refers_to")
    one = heads.where("kind = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    return one.unionByName(revisits.select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("to").alias("refers_to")))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    plain, lean = shared_path(spark, "warc"), shared_path(spark, "warc-lean")
    kind = pages.schema["page_id"].dataType.simpleString()
    per_file = records_per_file(pages)
    write_archive(pages, plain, per_file=per_file)
    resolve_revisits(spark, plain, lean, per_file=per_file, id_type=kind)
    return resolved(spark, lean).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


# DuckDB: the same decisions from the table; of equal page ids, or with null ids only, one record is the response.
OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low,
         row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS k FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN low END AS refers_to FROM f
"""
