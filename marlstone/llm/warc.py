"""WARC archives: writing captures, reading records, assembling transactions.

``write_captures`` writes request, response or revisit, and metadata records.
A record is the text row "header, blank line, block" and Spark's text writer
ends it by the separator CR LF CR LF, which is how WARC ends its records; so the
archives are ordinary (gzipped) WARC files made under Spark's commit protocol,
in any file system that Spark reaches.

``read_records`` reads any such archive as a stream of separator-delimited
chunks and puts records together by Content-Length, so separators inside a
payload do no harm and a task holds one record, not one file.

``assemble`` joins request, response (or revisit) and metadata records through
WARC-Concurrent-To and gives one nested row per capture. A capture's request and
metadata are those with the smallest record id; n_requests and n_metadata count
all that are there, and ``surplus`` returns the rest as rows of their own. A
record may name several captures and then belongs to each. Digests and lengths
are those of the payload as it was read; a revisit, which has none, takes those
of the response it refers to.

Defined results: a null payload is an empty one. Of captures with equal payloads
the one with the smallest page_id (null ids last, then the first row) is the
response. A revisit of a response that isn't there has null digest and length.
An empty table gives archives without records. Repeated rows are captures of their own. Records without a capture
don't appear in ``assemble`` but in ``surplus``. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, scanned, scratch, store

BREAK = "\r\n"
END = BREAK * 2
RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, uri string, declared_digest string, payload_digest string, payload_length long, declared_length long, fields map<string,string>, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column; 40 bits are 8 letters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str | Column, rid: Column, extra: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), rid)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in extra]  # null values drop out of concat_ws
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(BREAK, *lines), F.lit(END), block)


def write_captures(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", least_revisit: int = 0) -> str:
    """Archives of ``pages`` (page_id, url, html) in the shared folder; returns their path.

    Payloads of at least ``least_revisit`` bytes that equal an earlier one are
    written as revisit records, which have its headers but no payload.
    """
    rows = keyed(scanned(pages.select("page_id", "url", "html"), "pages"), "pages", "row").select(
        "row", F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")
    ).withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    # digests that occur more than once, with the capture that keeps the payload; a third of all rows may have one of them
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = rows.filter(F.col("size") >= least_revisit).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = store(firsts.filter("n > 1").select("digest", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")), "firsts")
    known = rows.join(firsts, "digest", "left")  # small ones are broadcast by their size; otherwise a hot digest's rows are split
    is_revisit = F.coalesce(F.col("first_row") != F.col("row"), F.lit(False)) & (F.col("size") >= least_revisit)
    url = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    text_row = F.concat_ws("#", "row.file", F.col("row.at").cast("string"))
    first_row = F.concat_ws("#", "first_row.file", F.col("first_row.at").cast("string"))
    main, request, meta = (_urn(F.lit(k), text_row, "digest") for k in ("response", "request", "metadata"))
    target = [("WARC-Target-URI", F.when(url != "", url)), ("WARC-Date", F.lit(date))]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("size").cast("string"), F.lit(END))
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    profile = [
        ("WARC-Profile", F.when(is_revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(is_revisit, _urn(F.lit("response"), first_row, "digest"))),
    ]
    kind = F.when(is_revisit, "revisit").otherwise("response")
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*)$", 1)
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{BREAK}Host: "), host, F.lit(END))
    fields = F.concat_ws(BREAK, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.when(is_revisit, F.concat(F.lit("revisits-page-id: "), F.col("first_page").cast("string"))), F.lit("via: crawl"))
    records = F.array(
        _record("request", request, [*target, ("WARC-Concurrent-To", main)], "application/http;msgtype=request", ask),
        _record(kind, main, [*target, *profile, *digest], "application/http;msgtype=response", F.when(is_revisit, http).otherwise(F.concat(http, "html"))),
        _record("metadata", meta, [*target, ("WARC-Concurrent-To", main)], "application/warc-fields", F.concat(fields, F.lit(BREAK))),
    )
    path_out = scratch(pages.sparkSession, "warc")
    known.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path_out)
    return path_out


def _headers(block: bytes) -> list[tuple[str, str]]:
    """(name, value) of all header lines in their order, names in lower case; a name may occur again."""
    lines = block.decode("utf-8", "replace").split(BREAK)
    return [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines) if k]


def _parse(head: bytes, block: bytes, keep: bool) -> tuple:
    named = _headers(head.partition(b"\r\n")[2])
    h = dict(named)
    kind = h.get("warc-type", "")
    beside = [v for k, v in named if k == "warc-concurrent-to"] or None
    declared, fields, payload = None, {}, block
    if "application/http" in h.get("content-type", ""):
        top, _, payload = block.partition(b"\r\n\r\n")
        fields = dict(_headers(top.partition(b"\r\n")[2]))
        declared = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
    elif h.get("content-type", "").startswith("application/warc-fields"):
        fields = dict(_headers(block))
    stated = h.get("warc-payload-digest", "").rpartition(":")[2] or None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None
    return h.get("warc-record-id"), kind, beside, h.get("warc-refers-to"), h.get("warc-target-uri"), stated, digest, len(payload), declared, list(fields.items()), payload if keep else None


def records_of(chunks: Iterator[tuple[str, bytes]], keep: bool = True) -> Iterator[tuple]:
    """Records of a stream of (file, chunk), each chunk as it stood before a separator."""
    end = END.encode()
    file, head, body, need = None, None, [], 0
    for name, chunk in chunks:
        if name != file:
            file, head, body, need = name, None, [], 0
        if head is None:
            start = chunk.lstrip(b"\r\n")
            if not start.startswith(b"WARC/"):
                continue
            head = start
            size = dict(_headers(head.partition(b"\r\n")[2])).get("content-length", "0")
            need, body = int(size) if size.isdigit() else 0, []
            if need == 0:
                yield _parse(head, b"", keep)
                head = None
            continue
        body.append(chunk)
        need -= len(chunk)
        if need <= 0:
            block = end.join(body)
            yield _parse(head, block if need == 0 else block[:need], keep)
            head = None
        else:
            need -= len(end)
            if need <= 0:  # the block ends inside or right behind this separator
                block = end.join([*body, b""])
                yield _parse(head, block if need == 0 else block[:need], keep)
                head = None


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the .gz archives under ``path``; ``payload`` False leaves that column null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.replace("map<string,string>", "map").split(", ")]
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary())

        def chunks():
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns))

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        held, size = [], 0
        for r in records_of(chunks(), payload):
            held.append(r)
            size += len(r[-1] or b"") + 500
            if size > 8_000_000:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    # a gzip file is read by one task, in order, which the stream of chunks needs
    chunks = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path)
    return chunks.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response, request, metadata and the counts of the latter two.

    response has payload_digest and payload_length of the payload that was read
    (a revisit's are those of the response it refers to), and digest_ok: whether
    the header states the same digest.
    """
    main = records.filter("type in ('response', 'revisit')")
    whole = main.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("r_digest"), F.col("payload_length").alias("r_length"))
    known = main.filter("type = 'revisit'").join(whole.hint("merge"), "refers_to", "left")  # a row per record: a merge at every size; a hot response's revisits are split
    known = known.withColumn("payload_digest", F.col("r_digest")).withColumn("payload_length", F.col("r_length")).select(*records.columns)
    main = main.filter("type = 'response'").select(*records.columns).unionByName(known)
    same = F.col("declared_digest") == F.col("payload_digest")
    out = main.select(F.col("record_id").alias("capture_id"), "uri", F.struct("record_id", "type", "refers_to", "payload_digest", same.alias("digest_ok"), "payload_length", "payload").alias("response"))
    for kind, count in (("request", "n_requests"), ("metadata", "n_metadata")):
        own = records.filter(F.col("type") == kind).select("record_id", "fields", F.explode(F.array_distinct("concurrent_to")).alias("capture_id"))
        one = own.groupBy("capture_id").agg(F.min_by(F.struct("record_id", "fields"), "record_id").alias(kind), F.count(F.lit(1)).alias(count))
        out = out.join(one, "capture_id", "left").withColumn(count, F.coalesce(count, F.lit(0).cast("long")))
    return out


def surplus(records: DataFrame) -> DataFrame:
    """Requests and metadata that ``assemble`` doesn't show: further ones of a capture, and those of none."""
    main = records.filter("type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), F.lit(True).alias("known"))
    rest = records.filter("type in ('request', 'metadata')")
    at = rest.select("record_id", "type", F.explode(F.array_distinct("concurrent_to")).alias("capture_id")).join(main, "capture_id")
    shown = at.groupBy("capture_id", "type").agg(F.min("record_id").alias("record_id")).select("record_id", "type").distinct()
    return rest.join(shown, ["record_id", "type"], "left_anti").select(*records.columns)


def capture_digests(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of assembled captures."""
    fields = F.col("metadata.fields")
    return captures.select(
        F.try_element_at(fields, F.lit("page-id")).cast("long").alias("page_id"), F.col("response.payload_length").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.try_element_at(fields, F.lit("revisits-page-id")).cast("long").alias("refers_to"),
    )
