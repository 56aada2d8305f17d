"""Operator 10: WARC archives, written and read back as assembled captures.

Writing gives every page three WARC/1.1 records: a request, a response (or a revisit of
a response with the same payload) and a metadata record; request and metadata
name the capture in ``WARC-Concurrent-To``. The JVM's text writer makes the
archives: one record a row, and the blank lines that end a WARC record are its
line separator, so any store that Spark writes to will do. Files are gzip.

Reading takes files as the JVM's text reader streams them, cut at blank lines, so a task holds one record at
a time; records are put together by ``Content-Length``. Then it assembles transactions:
requests and metadata join their capture through the concurrent-to identifier,
revisits join the response they refer to, and each capture becomes one nested row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches

#: Payloads under this many bytes are always stored anew.
LEAST_REVISIT = 100
_EOL = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(kind: str, page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, urn: Column, date: str, headers: list[tuple[str, Column]], content_type: str, block: Column, block_bytes: Column) -> Column:
    """One record's text; headers whose value is null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), urn), F.lit(f"WARC-Date: {date}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), block_bytes.cast("string"))]
    return F.concat(F.concat_ws(_EOL, *lines), F.lit(_EOL * 2), block)


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 9000) -> None:
    """Write pages (``page_id``, ``url``, ``html``) as WARC records under ``path``.

    Of pages whose equal payload has 100 bytes or more, the one with the
    smallest id is stored as response and the others as revisits of it. Null
    html is an empty payload; a null url leaves ``WARC-Target-URI`` out, white
    space in it is percent-encoded; a null id leaves ``pageId`` out and never is
    the smallest. Repeated rows are written each. Revisits are found on ids and digests alone; pages of 100 bytes
    or more then join them by id and digest, which shuffles payloads evenly, once, where the revisits are too many to broadcast.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha2("html", 256)).withColumn("n", F.octet_length("html"))
    page, digest, large = F.col("page_id"), F.col("digest"), F.col("n") >= LEAST_REVISIT
    keys = p.where(large).groupBy("page_id", "digest").count().drop("count")
    twice = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 AND first IS NOT NULL").select("digest", "first")
    again = keys.join(twice, "digest").where(~page.eqNullSafe(F.col("first"))).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first")
    met = p.where(large).join(again, page.eqNullSafe(F.col("_page")) & (digest == F.col("_digest")), "left").drop("_page", "_digest")
    p = met.unionByName(p.where(~large).withColumn("first", F.lit(None).cast(pages.schema["page_id"].dataType)))
    revisit = F.col("first").isNotNull()
    capture = _urn("capture", page, digest)
    uri = F.col("url")
    for raw, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        uri = F.replace(uri, F.lit(raw), F.lit(code))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("n").cast("string"), F.lit(_EOL * 2))
    block = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    host = F.coalesce(F.regexp_extract(uri, r"^[a-z]+://([^/?#]*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_extract(uri, r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/")), F.lit(f" HTTP/1.1{_EOL}Host: "), host, F.lit(_EOL * 2))
    about = F.concat(F.coalesce(F.concat(F.lit("pageId: "), page.cast("string"), F.lit(_EOL)), F.lit("")), F.lit("payloadLength: "), F.col("n").cast("string"), F.lit(_EOL))
    target = ("WARC-Target-URI", uri)
    records = F.array(
        _record("request", _urn("request", page, digest), date, [target, ("WARC-Concurrent-To", capture)], "application/http;msgtype=request", asked, F.octet_length(asked)),
        _record(
            F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            capture,
            date,
            [target, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), ("WARC-Refers-To", F.when(revisit, _urn("capture", F.col("first"), digest))), ("WARC-Profile", F.when(revisit, F.lit(_PROFILE)))],
            "application/http;msgtype=response",
            block,
            F.octet_length(head) + F.when(revisit, F.lit(0)).otherwise(F.col("n")),
        ),
        _record("metadata", _urn("metadata", page, digest), date, [target, ("WARC-Concurrent-To", capture)], "application/warc-fields", about, F.octet_length(about)),
    )
    writer = p.select(F.explode(records).alias("value")).write.option("lineSep", _EOL * 2).option("compression", "gzip")
    writer.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


class Records:
    """Records of a stream of bytes, one held at a time.

    ``feed`` returns (headers with lower-case names, block) of those that end within the bytes so far.
    Blank lines between records are skipped; a ValueError says where a record doesn't start.
    """

    def __init__(self):
        self._parts: list[bytes] = []
        self._size, self._need = 0, 0  # bytes held, and those without which nothing can end
        self._at = 0

    def feed(self, data: bytes) -> list[tuple[dict[str, str], bytes]]:
        self._parts.append(data)
        self._size += len(data)
        found: list[tuple[dict[str, str], bytes]] = []
        while self._size >= max(self._need, 1):
            held = b"".join(self._parts)
            start = len(held) - len(held.lstrip(b"\r\n"))
            end = held.find(b"\r\n\r\n", start)
            if held[start : start + 5] != b"WARC/"[: len(held) - start]:
                raise ValueError(f"no WARC record at byte {self._at + start}")
            need = len(held) + 1
            if end >= 0:
                lines = held[start:end].decode("utf-8", "replace").split(_EOL)[1:]
                headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
                need = end + 4 + int(headers["content-length"])
                if need <= len(held):
                    found.append((headers, held[end + 4 : need]))
                    self._at += need
                    held, need = held[need:], 0
            self._parts, self._size, self._need = [held], len(held), need
            if need:
                break
        return found

    def end(self) -> None:
        if b"".join(self._parts).strip(b"\r\n"):
            raise ValueError(f"the record at byte {self._at} is cut short")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a whole archive, in order."""
    records = Records()
    yield from records.feed(data)
    records.end()


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """All records of the archives under ``path``, one row each.

    ``digest`` and ``payload_bytes`` are computed from the payload as read (for
    a revisit: its declared digest, and null). A response whose payload doesn't
    match its declared digest raises. ``payload`` adds the payload's bytes.
    """
    schema = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, digest string, payload_bytes long, block string" + ", payload binary" * payload
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def row(h: dict[str, str], block: bytes) -> list:
        kind = h.get("warc-type")
        declared = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
        digest, size, body, text = declared, None, None, None
        if kind == "response":
            body = block[block.index(b"\r\n\r\n") + 4 :]
            digest, size = hashlib.sha256(body).hexdigest(), len(body)
            if declared not in (None, digest):
                raise ValueError(f"{h['warc-record-id']}: payload doesn't match its digest")
        elif kind != "revisit":
            text = block.decode("utf-8", "replace")
        return [h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, size, text] + [body] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = Records()
        for batch in batches:
            rows: list[list] = []
            held = 0
            for piece in batch.column(0):
                for h, block in records.feed(piece.as_py() + b"\r\n\r\n"):
                    rows.append(row(h, block))
                    held += len(block) if payload else 0
                    if held > 32 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, names)
        records.end()

    small_batches(spark)
    pieces = spark.read.option("lineSep", _EOL * 2).text(path).select(F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(run, schema)


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for c, n in zip(zip(*rows), names)], names)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: the transaction its records form.

    Requests and metadata join through ``concurrent_to``, revisits their
    response through ``refers_to``. Returns ``record_id``, ``record_type``,
    ``target_uri``, ``payload_bytes``, ``payload_digest``, ``page_id``,
    ``refers_to_page``, ``request`` and ``metadata`` structs (null if missing),
    and ``payload`` where the records have it. Payload columns of a revisit are
    those of the full payload. Repeated transactions stay repeated.
    """
    has_payload = "payload" in records.columns
    side = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    one = lambda kind: F.min(F.when(F.col("type") == kind, F.struct("record_id", "block"))).alias(kind)
    side = side.groupBy("concurrent_to").agg(one("request"), one("metadata"))
    main = records.where(F.col("type").isin("response", "revisit")).select("record_id", F.col("type").alias("record_type"), "refers_to", "target_uri", "digest", "payload_bytes", *(["payload"] if has_payload else []))
    field = lambda name, block: F.nullif(F.regexp_extract(block, rf"(?m)^{name}: (\d+)\r?$", 1), F.lit("")).cast("long")
    pairs = side.withColumn("page_id", field("pageId", F.col("metadata.block"))).withColumn("declared", field("payloadLength", F.col("metadata.block")))
    joined = main.join(pairs, main.record_id == pairs.concurrent_to, "left")
    named = pairs.select(F.col("concurrent_to").alias("of"), F.col("page_id").alias("refers_to_page"))
    # a response refers to nothing: dealing it by its own id keeps nulls from meeting in one task
    whole = joined.withColumn("_of", F.coalesce("refers_to", "record_id")).join(named, F.col("_of") == named.of, "left")
    whole = whole.withColumn("refers_to_page", F.when(F.col("refers_to").isNotNull(), F.col("refers_to_page")))
    return whole.select(
        "record_id", "record_type", "target_uri", F.coalesce("payload_bytes", "declared").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "page_id", "refers_to_page", "request", "metadata", *(["payload"] if has_payload else [])
    )


def round_trip(pages: DataFrame, payload: bool = False) -> DataFrame:
    """Write pages as archives in the shared folder and read the captures back.

    An empty table gives no capture; columns but ``page_id``, ``url`` and
    ``html`` are not read.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path)
    return captures(read_records(spark, path, payload))
