"""WARC archives: written from pages, read back in any order, and assembled to captures.

Records are written by Spark's own text writer with the blank lines between records as separator, so the
files are plain gzipped WARC, commits are atomic, and any file system that Spark knows will do. The same
separator streams archives back; a parser in each task puts records together by their Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, materialise, small

GAP = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 60_000


def base32(sha1: Column) -> Column:
    """A hexadecimal SHA-1 in base32: ten digits at a time are forty bits, so eight letters."""
    parts = (F.lpad(F.conv(F.substring(sha1, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4))
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _uuid(*parts: Column) -> Column:
    m = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column, own: Column, block: Column, content: str, *more: Column) -> Column:
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), own),
        F.lit(f"WARC-Date: {DATE}"),
        *more,
        F.lit(f"Content-Type: {content}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    return F.concat(head, F.lit(GAP), block)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)  # null, and so left out, with a null value


def _line(value: Column) -> Column:
    """A header's value on one line: control characters and blanks as percent codes."""
    value = value.cast("string")
    for c in "\r\n\t ":
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return value


def write_captures(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = 0) -> None:
    """Write a request, a response or revisit, and a metadata record for each page below ``path``.

    Of pages with equal payloads of at least ``revisit_bytes`` bytes, those with the smallest key are
    responses and the others revisit it. Null keys come last; where all are null, all are responses. A
    null payload is empty; a null URL leaves its header out. Repeated rows are captures of their own: all
    that have the smallest key are responses. Payloads are not shuffled while the table of repeated
    digests is small by count.
    """
    at = pages.select(F.col(key).alias("k"), _line(F.col(url)).alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))
    at = at.withColumns({"d": F.sha1("p"), "n": F.octet_length("p")})
    seen = at.where(F.col("n") >= revisit_bytes).groupBy("d").agg(F.min(F.when(F.col("k").isNotNull(), F.struct("k", "u"))).alias("first"), F.count("*").alias("c"))
    first = small(materialise(seen.where("c > 1 AND first IS NOT NULL").select(F.col("d").alias("fd"), "first"), "firsts"))
    at = at.join(first, (F.col("d") == F.col("fd")) & ~F.col("k").eqNullSafe(F.col("first.k")) & (F.col("n") >= revisit_bytes), "left")
    at = at.withColumns({"again": F.col("fd").isNotNull(), "seq": F.monotonically_increasing_id()})
    response, request, metadata = (_uuid(F.lit(x), F.col("k").cast("string"), F.col("seq").cast("string")) for x in ("response", "request", "metadata"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit(GAP))
    uri, digest = _header("WARC-Target-URI", F.col("u")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("d")))
    again = F.col("again")
    target = F.regexp_extract(F.coalesce("u", F.lit("")), r"://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract(F.coalesce("u", F.lit("")), r"://([^/?#]*)", 1)
    fields = F.concat_ws("\r\n", _header("page", F.col("k").cast("string")), _header("refers-to-page", F.when(again, F.col("first.k").cast("string"))), F.lit("via: table"))
    records = F.array(
        _record(F.lit("request"), request, F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(GAP)), "application/http;msgtype=request", uri, F.concat(F.lit("WARC-Concurrent-To: "), response)),
        _record(
            F.when(again, "revisit").otherwise("response"),
            response,
            F.concat(http, F.when(again, "").otherwise(F.col("p"))),
            "application/http;msgtype=response",
            uri,
            digest,
            F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
            F.when(again, _header("WARC-Refers-To-Target-URI", F.col("first.u"))),
            F.when(again, F.lit(f"WARC-Refers-To-Date: {DATE}")),
        ),
        _record(F.lit("metadata"), metadata, fields, "application/warc-fields", uri, F.concat(F.lit("WARC-Concurrent-To: "), response)),
    )
    # A column of its own, as ids and digests that records share are then made once.
    at.select(records.alias("records")).select(F.explode("records").alias("value")).write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


RECORD = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("concurrent_to", T.ArrayType(T.StringType())),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("http", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha1", T.StringType()),
    ]
)


class Parser:
    """Puts the pieces of one archive, cut at blank lines, together to records."""

    def __init__(self) -> None:
        self.head: dict[str, list[str]] | None = None
        self.parts: list[bytes] = []
        self.have = 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
        if self.head is None:
            if not (piece := piece.lstrip(b"\r\n")):
                return
            first, *lines = piece.decode("utf-8", "replace").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"no WARC record begins with {first[:40]!r}")
            self.head = {}
            for name, _, value in (x.partition(":") for x in lines):
                self.head.setdefault(name.strip().lower(), []).append(value.strip())
            return
        if self.parts:
            self.parts.append(GAP.encode())
            self.have += len(GAP)
        self.parts.append(piece)
        self.have += len(piece)
        size = int(self.head.get("content-length", ["0"])[0])
        if self.have < size:
            return
        data = b"".join(self.parts)
        head, rest = self.head, data[size:]
        self.head, self.parts, self.have = None, [], 0
        yield head, data[:size]
        if rest:
            if not rest.startswith(GAP.encode()):
                raise ValueError("a WARC record is longer than its Content-Length")
            yield from self.feed(rest[len(GAP) :])

    def end(self) -> Iterator[tuple[dict[str, list[str]], bytes]]:
        if self.head is not None:
            yield from self.feed(b"")
        if self.head is not None:
            raise ValueError("an archive ends within a WARC record")


def _row(head: dict[str, list[str]], block: bytes) -> dict:
    one = lambda name: head.get(name, [None])[0]
    http, payload = None, block
    if (one("content-type") or "").startswith("application/http"):
        first, _, payload = block.partition(GAP.encode())
        http = first.decode("utf-8", "replace")
    return {
        "type": one("warc-type"),
        "record_id": one("warc-record-id"),
        "concurrent_to": head.get("warc-concurrent-to", []),
        "headers": [(name, ", ".join(values)) for name, values in head.items()],
        "http": http,
        "payload": payload,
        "payload_bytes": len(payload),
        "payload_sha1": base64.b32encode(hashlib.sha1(payload).digest()).decode(),
    }


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the gzipped archives below ``path``.

    A task streams its archives and holds one record at a time. ``http`` is the HTTP head, ``payload`` what
    follows it, or the block of other records. ``concurrent_to`` has the ids of all headers of that name; of
    other repeated headers ``headers`` joins the values by commas. A cut-off or damaged archive raises.
    """
    lines = spark.read.option("lineSep", GAP).text(path).select(F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("file"))
    kinds = pa.schema(
        [("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("headers", pa.map_(pa.string(), pa.string())), ("http", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, last, rows, held = Parser(), None, [], 0

        def flush():
            nonlocal rows, held
            made, rows, held = pa.RecordBatch.from_pylist(rows, kinds), [], 0
            return made

        for batch in batches:
            for value, file in zip(batch.column("value"), batch.column("file").to_pylist(), strict=True):
                if file != last:
                    rows += [_row(*x) for x in parser.end()]
                    parser, last = Parser(), file
                for record in parser.feed(value.as_py()):
                    rows.append(_row(*record))
                    held += len(record[1])
                if held > 4 << 20 or len(rows) > 5000:
                    yield flush()
        rows += [_row(*x) for x in parser.end()]
        if rows:
            yield flush()

    return lines.mapInArrow(work, RECORD)


RESPONSES = ("response", "revisit")


def _transactions(records: DataFrame, work: Scratch) -> DataFrame:
    """``record_id`` and ``of``, the response it belongs to, of every request and metadata record.

    Concurrent-to ids are followed in either direction. What a response names, or what names it, is its own; a
    record that only names other requests or metadata belongs where these do. Ids alone are joined.
    """
    ids = records.select("record_id", F.col("type").isin(*RESPONSES).alias("response"), "concurrent_to")
    named = ids.select("record_id", "response", F.explode("concurrent_to").alias("other"))
    links = work.write(named.join(ids.select(F.col("record_id").alias("other"), F.col("response").alias("to_response")), "other").distinct(), "links")
    own = links.where("NOT response AND to_response").select("record_id", F.col("other").alias("of"))
    own = own.union(links.where("response AND NOT to_response").select(F.col("other"), F.col("record_id")))
    found = new = work.write(own.distinct(), "own")
    beside = links.where("NOT response AND NOT to_response").select("record_id", "other")
    while not beside.isEmpty():
        both = beside.union(beside.select("other", "record_id")).join(new.withColumnRenamed("record_id", "other"), "other")
        new = work.write(both.select("record_id", "of").distinct().join(found, "record_id", "left_anti"), "further")
        if new.isEmpty():
            break
        found = found.union(new)
    return found


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: its ``response`` (or revisit), and its ``requests`` and ``metadata`` as arrays.

    Concurrent-to ids tie requests and metadata to a response, whichever of them names which, and through one
    another. A capture has as many of them as name it, in the order of their ids, or empty arrays; one that
    names several responses is in each of their rows. Requests and metadata without a response are left
    out; of no records there are no captures. A response that the archives hold twice is two captures. The records are written
    once; ids are joined to find the captures, and what is read of a response is shuffled once, to one join.
    """
    work = Scratch(records.sparkSession)
    records = work.write(records, "records", "zstd")
    names = [f.name for f in RECORD.fields]
    by_id = lambda x, y: F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0)
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct(*names))), by_id)
    parts = records.where(F.col("type").isin("request", "metadata")).join(_transactions(records, work), "record_id")
    parts = parts.groupBy("of").agg(listed("request").alias("requests"), listed("metadata").alias("metadata"))
    # Nested after the join, so that what a reader does not ask for is not shuffled.
    out = records.where(F.col("type").isin(*RESPONSES)).join(parts, F.col("record_id") == F.col("of"), "left")
    none = F.array().cast(T.ArrayType(RECORD))
    return out.select(F.coalesce("requests", none).alias("requests"), F.struct(*names).alias("response"), F.coalesce("metadata", none).alias("metadata"))


def digest_rows(captures: DataFrame) -> DataFrame:
    """Per capture: its page, payload size and digest, whether it revisits and what, by its metadata's fields."""
    # Each field is asked for once, so that payloads need not be read again.
    at = captures.select(
        F.array_join(F.transform("metadata", lambda m: m["payload"].cast("string")), "\n").alias("fields"),
        *(F.col(f"response.{c}").alias(c) for c in ("type", "http", "payload_bytes", "payload_sha1")),
        F.col("response.headers")["warc-payload-digest"].alias("digest"),
    )
    number = lambda name: F.regexp_extract("fields", rf"(?m)^{name}: (-?\d+)\r?$", 1).try_cast("long")
    again = F.col("type") == "revisit"
    size = F.regexp_extract("http", r"(?i)(?:^|\n)Content-Length: *(\d+)", 1).try_cast("long")
    return at.select(
        number("page").alias("page_id"),
        F.when(again, size).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.replace("digest", F.lit("sha1:"), F.lit(""))).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers-to-page").alias("refers_to"),
    )
