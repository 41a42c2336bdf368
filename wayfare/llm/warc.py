"""WARC archives: write request, response or revisit, and metadata records, and assemble the transactions
of an archive by joining its records through their concurrent-to identifiers, one nested row per capture.

Archives are written by Spark's own text writer with CRLF between records (so task commits, retries and
any Hadoop store work as for every table) and gzip, one stream per file, not one member per record. They are read back
as a stream of CRLF pieces, and records are cut by Content-Length alone, so a payload may hold anything, record
headers included. An archive must reach one task whole: gzip ones always do; reading fails with a clear error if a
plain one is larger than a file split.

Payloads are text, stored as UTF-8; null counts as empty. Of records with equal payloads of at least
``least_revisit`` bytes the one with the largest id is the response, the others are revisits without
a body; of several rows with that id one is the response. Every row is a capture of its own, also where rows agree in all. Line ends in an address are
percent-encoded; a null address has no target header. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, work_dir

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 60_000


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _record(kind: str, rid: Column, block: Column, content_type: str, *headers: tuple[str, Column]) -> Column:
    """One record without its last CRLF, which the writer adds. Headers with a null value are left out."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), rid)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n"))


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_revisit: int = 1000) -> DataFrame:
    """pages as _id, _url, _body with digest, bytes, its record id, and for revisits refers_id."""
    p = pages.select(F.col(id_col).cast("long").alias("_id"), F.regexp_replace(F.regexp_replace(url_col, "\r", "%0D"), "\n", "%0A").alias("_url"), F.coalesce(F.col(body_col), F.lit("")).alias("_body"))
    p = p.withColumn("digest", F.sha1(F.col("_body").cast("binary"))).withColumn("bytes", F.octet_length("_body").cast("long"))
    p = p.withColumn("rid", _uuid(F.lit("response"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.coalesce("_url", F.lit("null")), F.col("digest")))
    p = _numbered(p)
    narrow = p.where(F.col("bytes") >= least_revisit).select("_id", "digest", "bytes", "rid")
    # written, so that the join has two plain sides and a very common payload is split by adaptive skew handling
    winner = cut(narrow.groupBy("digest", "bytes").agg(F.max(F.struct("_id", "rid")).alias("w"), F.count("*").alias("n")).where("n > 1").drop("n"), "winners")
    revisit = narrow.join(winner, ["digest", "bytes"]).where("rid <> w.rid").select("rid", F.col("w.rid").alias("refers_id"))
    return p.join(revisit, "rid", "left")


def _numbered(p: DataFrame) -> DataFrame:
    """A record id of its own for every row: of rows that agree in id, address and payload the first keeps the id made from these,
    the others add their number. Such rows are counted without their bodies; only they are grouped, one body each."""
    repeats = cut(p.groupBy("rid").agg(F.count("*").alias("_n")).where("_n > 1"), "repeats")
    if repeats.isEmpty():
        return p
    one = p.join(repeats, "rid").groupBy("rid").agg(*[F.first(c).alias(c) for c in p.columns if c != "rid"], F.first("_n").alias("_n"))
    each = one.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    each = each.withColumn("rid", F.when(F.col("_k") == 1, F.col("rid")).otherwise(_uuid(F.lit("response"), F.col("rid"), F.col("_k").cast("string"))))
    return p.join(repeats.select("rid"), "rid", "left_anti").unionByName(each.select(*p.columns))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_revisit: int = 1000) -> None:
    """Write the archives: per page a request, a response or revisit, and a metadata record."""
    p = plan(pages, id_col, url_col, body_col, least_revisit)
    rid, url, when = F.col("rid"), F.col("_url"), F.lit(date)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    common = (("WARC-Date", when), ("WARC-Target-URI", url))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = "application/http; msgtype="
    request = _record("request", _uuid(F.lit("request"), rid), F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")), f"{http}request", *common, ("WARC-Concurrent-To", rid))
    response = _record("response", rid, F.concat(head, F.col("_body")), f"{http}response", *common, digest)
    again = _record("revisit", rid, head, f"{http}response", *common, digest, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", F.col("refers_id")))
    meta = _record("metadata", _uuid(F.lit("metadata"), rid), F.concat(F.lit("page-id: "), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit("\r\n")), "application/warc-fields", *common, ("WARC-Concurrent-To", rid))
    main = F.when(F.col("refers_id").isNull(), response).otherwise(again)
    lines = p.select(F.explode(F.array(request, main, meta)).alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


RECORD = "type string, record_id string, concurrent_to string, refers_to string, uri string, date string, profile string, digest string, http_head string, block binary"
_HEADERS = {b"warc-record-id": 1, b"warc-concurrent-to": 2, b"warc-refers-to": 3, b"warc-target-uri": 4, b"warc-date": 5, b"warc-profile": 6, b"warc-payload-digest": 7}
_CHUNK_BYTES = 16 << 20


def _parse(lines: Iterator[bytes]) -> Iterator[list]:
    """Records from the CRLF pieces of archives, one after another. A record cut off by the end is an error."""
    for first in lines:
        if not first.startswith(b"WARC/"):
            if first:
                raise ValueError(f"not a record: {first[:60]!r}")
            continue
        row: list = [None] * 10
        length = 0
        http = False
        for line in lines:
            if not line:
                break
            name, _, value = line.partition(b":")
            name, value = name.strip().lower(), value.strip()
            if name == b"content-length":
                length = int(value)
            elif name == b"warc-type":
                row[0] = value.decode()
            elif name == b"content-type":
                http = value.startswith(b"application/http")
            elif name in _HEADERS:
                row[_HEADERS[name]] = value.decode("utf-8", "replace")
        parts, size = [], -2
        while size < length:
            part = next(lines, None)
            if part is None:
                raise ValueError("an archive ends inside a record")
            parts.append(part)
            size += len(part) + 2
        block = b"\r\n".join(parts)
        if size > length:  # the block's own last CRLF was read as a separator
            block = block[:length]
        if http:
            head, mark, body = block.partition(b"\r\n\r\n")
            row[8], block = head.decode("utf-8", "replace"), body if mark else b""
        row[9] = block
        yield row


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path. For http records block is the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (x.as_py() or b"" for b in batches for x in b.column(0))
        held: list[list] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:9]), pa.array(cols[9], pa.binary())], _NAMES)

        for row in _parse(lines):
            held.append(row)
            size += len(row[9])
            if size > _CHUNK_BYTES or len(held) >= 5000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    text = spark.read.option("lineSep", "\r\n").text(path)
    torn = "an archive without compression is larger than a file split; compress it or raise spark.sql.files.maxPartitionBytes"
    text = text.where(F.assert_true(F.col("_metadata.file_block_length") == F.col("_metadata.file_size"), torn).isNull())
    return text.select(F.col("value").cast("binary")).mapInArrow(run, RECORD)


_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: the response or revisit, and the requests and metadata joined to it
    through their concurrent-to identifiers. payload=False drops the bodies before anything is moved."""
    capture = F.coalesce("concurrent_to", "record_id")
    body = [F.col("block").alias("payload")] if payload else []
    # a revisit's own body is empty; its length stands in the kept http header
    told = F.regexp_extract("http_head", r"(?i)\r\ncontent-length:\s*([0-9]+)", 1).cast("long")
    is_main = F.col("type").isin("response", "revisit")
    main = F.when(is_main, F.struct(
        "type", "record_id", "refers_to", "uri", "date", "profile", "http_head",
        F.when(F.col("type") == "revisit", told).otherwise(F.length("block").cast("long")).alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.regexp_replace("digest", "^sha1:", "")).otherwise(F.sha1("block")).alias("payload_digest"), *body,
    ))
    request = F.when(F.col("type") == "request", F.struct("record_id", "uri", "date", "http_head"))
    fields = F.when(F.col("type") == "metadata", F.struct("record_id", "date", F.decode("block", "utf-8").alias("fields")))
    flat = records.select(capture.alias("capture_id"), main.alias("main"), request.alias("request"), fields.alias("metadata"))
    return flat.groupBy("capture_id").agg(F.first("main", True).alias("response"), F.collect_set("request").alias("requests"), F.collect_set("metadata").alias("metadata"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    rows = assemble(read(spark, path), payload=False).where("response is not null")
    page = F.regexp_extract(F.col("metadata")[0]["fields"], r"page-id: (-?[0-9]+)", 1)
    flat = cut(rows.select("response.record_id", F.when(page != "", page.cast("long")).alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("refers_id")), "captures")
    target = flat.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    return flat.join(target, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


SQL = {
    "op7_warc": """
with p0 as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d,
             md5('response|' || coalesce(page_id::varchar, 'null') || '|' || coalesce(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), 'null') || '|' || sha1(coalesce(html, ''))) as h from pages),
u as (select page_id, n, d, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' as u, row_number() over (partition by h) as k from p0),
m as (select *, md5('response|' || u || '|' || k::varchar) as h from u),
p as (select page_id, n, d, case when k = 1 then u else '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' end as record_id from m),
w as (select d, arg_max(page_id, row(page_id is not null, page_id, record_id)) as w, arg_max(record_id, row(page_id is not null, page_id, record_id)) as r from p where n >= 1000 group by d)
select page_id, n::bigint as payload_bytes, d as payload_digest, case when record_id <> r then 'revisit' else 'response' end as record_type,
       case when record_id <> r then w end as refers_to, record_id
from p left join w using (d)
""",
}
QUERIES = {"op7_warc": op7_warc}
