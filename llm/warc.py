"""WARC archives: writing, reading, and revisit records for payloads seen before.

Archives are written by Spark's text writer: a record is one string whose lines end
in CR LF, and the writer's line separator is the empty lines after a record; gzip
compresses each file. Reading streams each file through gzip and cuts records by
their Content-Length, so payloads may hold anything, WARC headers too.

Revisits are resolved on headers alone: the headers of all records are grouped by
payload digest (combined before the shuffle, so a payload in a third of all records
is no burden), the smallest id of a digest is its response, and the verdicts join
back by id. The second archive is written with fresh headers, without the payloads of
revisits.

Null payloads are empty ones. Ids are unique; a repeated row is one more record of
the same id, a response if its id is the smallest. A null id is no response if
another record has the payload. An empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import textkit
from llm.staging import by_bytes, shared_path, staged

#: Payloads below this size (bytes) are always responses.
LEAST_BYTES = 0
#: Bytes of records in a file at most (one record at least): a file is read whole.
FILE_BYTES = 64 << 20
#: Bytes decompressed at a time.
CHUNK = 1 << 20

_END = "\r\n\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string or binary column."""
    digest = F.sha1(payload)
    # 10 hexadecimal digits are 40 bits are 8 digits to the base 32
    parts = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _http(payload_bytes: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), payload_bytes.cast("string"), F.lit(_END))


def _record_id(key: Column) -> Column:
    """A stable urn:uuid made from a record's key, so that a task run twice writes the same record."""
    h = F.md5(key.cast("string"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record up to its last byte; fields that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *(F.coalesce(x, F.lit("")) for x in lines), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block)


def _one_line(value: Column) -> Column:
    """A header value: line breaks would end the header."""
    return F.regexp_replace(value, "[\\r\\n]+", " ")


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(record, size) a response record for each row, and the bytes of its payload."""
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    base = pages.select(pages[id_col].cast("string").alias("id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    block = F.concat(_http(F.octet_length("payload")), F.col("payload"))
    fields = [
        ("WARC-Type", F.lit("response")),
        ("WARC-Record-ID", _record_id(F.concat(F.lit("capture:"), F.coalesce("id", F.lit("")), F.lit(":"), F.sha1("payload")))),
        ("WARC-Target-URI", _one_line(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
        ("X-Source-ID", _one_line(F.col("id"))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
    ]
    return base.select(_record(fields, block).alias("record"), F.octet_length("payload").alias("size"))


def _classes(largest: int | None) -> Iterator[tuple[int, int]]:
    """Classes of payload sizes up to the largest: above, and up to so many bytes."""
    low, high = -1, 1 << 16
    while largest is not None and low < largest:
        yield low, high
        low, high = high, 4 * high


def _write(rows: DataFrame, path: str, high: int) -> None:
    """Writes a column of records with payloads up to ``high`` bytes, as many a file as ``FILE_BYTES`` surely hold."""
    folder = f"{path}/upto-{high}"
    rows.select("record").write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", max(1, FILE_BYTES // high)).text(folder)


def write_archive(rows: DataFrame, path: str) -> None:
    """Writes (record, size) as gzipped WARC files below a path, a folder for each class of payload sizes."""
    for low, high in _classes(rows.agg(F.max("size")).first()[0]):
        _write(rows.filter((F.col("size") > low) & (F.col("size") <= high)), path, high)


def _parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a decompressed file."""
    have, ended = bytearray(), False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(have) < n and not ended:
            more = next(stream, None)
            if more is None:
                ended = True
            else:
                have.extend(more)
        return len(have) >= n

    while True:
        while fill(2) and have.startswith(b"\r\n"):
            del have[:2]
        want = 512
        while (stop := have.find(b"\r\n\r\n")) < 0 and fill(want):
            want = len(have) + 512
        if stop < 0:
            if have.strip():
                raise ValueError("a WARC file ends inside a record's header")
            return
        first, *lines = have[:stop].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        if not fill(stop + 4 + size):
            raise ValueError("a WARC file ends inside a record's block")
        yield fields, bytes(have[stop + 4 : stop + 4 + size])
        del have[: stop + 4 + size]


def _unzipped(data: bytes) -> Iterator[bytes]:
    """A gzip file's bytes, all of its members."""
    with gzip.open(io.BytesIO(data)) as f:
        while piece := f.read(CHUNK):
            yield piece


_SCHEMA = "record_type string, record_id string, source_id string, url string, digest string, refers_to_id string, refers_to_source string, payload_bytes bigint, payload string"


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of an archive, without payloads unless asked for (revisits have none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("WARC-Type", "WARC-Record-ID", "X-Source-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "X-Refers-To-Source-ID", "X-Payload-Length")
        kind = pa.schema([(n.split(" ")[0], pa.int64() if n.endswith("bigint") else pa.string()) for n in _SCHEMA.split(", ")])

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for fields, block in _parse(_unzipped(data.as_py())):
                    f = [fields.get(n) for n in names]
                    if fields["WARC-Type"] == "revisit":
                        size, payload = int(f.pop()), None
                    else:
                        f.pop()
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size = len(payload)
                    f[4] = f[4].removeprefix("sha1:")
                    rows.append([*f, size, payload.decode("utf-8") if payloads and payload is not None else None])
                    held += len(block)
                    if held >= 4 * CHUNK or len(rows) >= 5_000:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    except AnalysisException:  # an archive without records has no folder
        return spark.createDataFrame([], _SCHEMA)
    return files.mapInArrow(textkit.tidy(run), _SCHEMA)


def verdicts(headers: DataFrame, id_type: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(record_id, first, first_record): of every record whose payload has a smaller id's copy, the id and record id of that; from headers only."""
    sized_enough = headers.filter(F.col("payload_bytes") >= least_bytes)
    key = F.col("source_id").cast(id_type)
    first = sized_enough.groupBy("digest", "payload_bytes").agg(F.min(F.struct(key.isNull().alias("none"), key.alias("id"), F.col("record_id").alias("record"))).alias("f"), F.count("*").alias("n"))
    first = staged(first.filter("n > 1").select("digest", "payload_bytes", F.col("f.id").alias("first"), F.col("f.record").alias("first_record")), "first-copies")
    joined = sized_enough.join(first, ["digest", "payload_bytes"])
    return joined.filter(F.col("first").isNotNull() & (key.isNull() | (key != F.col("first")))).select("record_id", "first", "first_record").distinct()


def deduplicate(spark: SparkSession, path: str, out: str, id_type: str, least_bytes: int = LEAST_BYTES) -> None:
    """Reads the archive at ``path`` and writes one at ``out`` with revisits instead of repeated payloads."""
    headers = staged(read_archive(spark, path, payloads=False).select("record_id", "source_id", "digest", "payload_bytes"), "headers")
    again = staged(verdicts(headers, id_type, least_bytes), "verdicts")
    for _, high in _classes(headers.agg(F.max("payload_bytes")).first()[0]):
        _write(_fresh(read_archive(spark, f"{path}/upto-{high}").join(again, "record_id", "left")), out, high)


def _fresh(rows: DataFrame) -> DataFrame:
    """(record) with fresh headers of records joined to their verdicts; revisits without payload."""
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")).otherwise(F.concat(_http(F.col("payload_bytes")), F.coalesce("payload", F.lit(""))))
    fields = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _record_id(F.concat(F.lit("dedup:"), F.col("record_id")))),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, _REVISIT_PROFILE)),
        ("X-Source-ID", F.col("source_id")),
        ("X-Refers-To-Source-ID", F.when(revisit, F.col("first"))),
        ("WARC-Refers-To", F.when(revisit, _record_id(F.concat(F.lit("dedup:"), F.col("first_record"))))),
        ("X-Payload-Length", F.when(revisit, F.col("payload_bytes"))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
    ]
    return rows.select(_record(fields, block).alias("record"))


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes ``pages`` as an archive, deduplicates it, and returns the second archive's records as read.

    One row per input row: id, ``payload_bytes`` and ``payload_digest`` of the full
    payload, ``record_type`` and ``refers_to`` (the id of the response with that payload).
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    by_bytes(spark)
    captured, deduplicated = shared_path(spark, "captured"), shared_path(spark, "deduplicated")
    write_archive(records(pages, id_col, url_col, payload_col), captured)
    deduplicate(spark, captured, deduplicated, kind, least_bytes)
    back = read_archive(spark, deduplicated, payloads=False)
    return back.select(
        F.col("source_id").cast(kind).alias(id_col),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to_source").cast(kind).alias("refers_to"),
    )
