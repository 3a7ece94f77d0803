"""WARC archives: written in segments with chunked framing, read back by segment reassembly."""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import importable, saved, shared_folder

#: A record's block is cut into segments of so many bytes; so many records go into one archive file.
SEGMENT_BYTES = 16 << 10
RECORDS_PER_FILE = 1000
CHUNK_BYTES = 4096
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_HEADER = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.S)
_READ = (
    "kind string, record_id string, origin string, number int, total long, key string, refers string, "
    "payload_bytes long, payload_digest string, block binary"
)


def chunked(body: bytes, most: int = CHUNK_BYTES) -> bytes:
    """body in HTTP chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for i in range(0, len(body), most) for x in (body[i : i + most],)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body of chunked framing; chunk extensions and trailers are passed over. Broken framing is an error."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        n = int(framed[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if framed[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(framed[end + 2 : end + 2 + n])
        at = end + 4 + n


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return ("\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block


def records(key, url, body: bytes, uid: str, refers, digest: str, segment: int) -> Iterator[bytes]:
    """A page's records: one revisit, or one response, cut into continuation records if it is long."""
    uri = re.sub(r"\s", "%20", url) if url else None
    name = f"<urn:uuid:{uid}>"
    shared = {"WARC-Record-ID": name, "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-ID": key}
    if refers is not None:
        yield record({"WARC-Type": "revisit", **shared, "X-Refers-To-Page-ID": refers, "X-Payload-Length": len(body)}, b"")
        return
    block = _HTTP + chunked(body)
    head = {"WARC-Type": "response", **shared, "Content-Type": "application/http;msgtype=response"}
    if len(block) <= segment:
        yield record(head, block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record({**head, "WARC-Segment-Number": 1}, parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if n == len(parts) else {}
        # the segment's number makes its own identifier differ from its origin's
        yield record({"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uid}-{n}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": n, **last}, part)


def write_archives(pages: DataFrame, key: str, url: str, body: str, path: str, least: int = 100, segment: int = SEGMENT_BYTES) -> None:
    """Writes a record per page to archive files below path.

    Of pages with equal bodies of at least `least` bytes, the one with the smallest key (and each row that
    repeats it) is a response, the others revisit it. A null body is empty. A page with a null key is a
    response unless another page with a key has its body. Columns besides the three are not looked at.
    """
    importable(pages.sparkSession)
    body_or_empty = F.coalesce(F.col(body), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body_or_empty.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    long = rows.where(F.octet_length("body") >= least)
    firsts = saved(long.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "first"))
    rows = rows.join(firsts, (F.col("digest") == F.col("same")) & (F.octet_length("body") >= least), "left")
    rows = rows.select("key", "url", F.col("body").cast("binary").alias("body"), "digest", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("refers"), F.expr("uuid()").alias("uid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                out = [x for r in batch.slice(i, 200).to_pylist() for x in records(r["key"], r["url"], r["body"], r["uid"], r["refers"], r["digest"], segment)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parsed(archive: bytes) -> Iterator[dict]:
    """The records of an archive, one after the other by their Content-Length."""
    at = 0
    while at < len(archive):
        m = _HEADER.match(archive, at)
        if not m:
            raise ValueError(f"no record at byte {at}")
        field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in m[1].decode().split("\r\n"))}
        end = m.end() + int(field["content-length"])
        if archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        number, total = field.get("warc-segment-number"), field.get("warc-segment-total-length")
        size = field.get("x-payload-length")
        yield {
            "kind": field["warc-type"], "record_id": field["warc-record-id"], "origin": field.get("warc-segment-origin-id"),
            "number": int(number) if number else None, "total": int(total) if total else None, "key": field.get("x-page-id"),
            "refers": field.get("x-refers-to-page-id"), "payload_bytes": int(size) if size else None,
            "payload_digest": field.get("warc-payload-digest", "").removeprefix("sha256:"), "block": archive[m.end() : end],
        }
        at = end + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below path, segments apart."""
    importable(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for content in batch.column(0):
                some: list[dict] = []
                for r in parsed(content.as_buffer().to_pybytes()):
                    some.append(r)
                    if len(some) == 200:
                        yield (made := pa.RecordBatch.from_pylist(some, schema or _arrow()))
                        schema, some = made.schema, []
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema or _arrow())

    return files.mapInArrow(run, _READ)


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _READ.split(", "))])


def reassembled(found: DataFrame) -> DataFrame:
    """One row per response and revisit: kind, key, refers, payload_bytes, payload_digest and payload (null for revisits).

    Continuation records are grouped by the identifier of their origin and ordered by segment number; the
    numbers must be gapless and the lengths add up to the total that the last one states. The payload is
    what is left after the HTTP head, out of its chunked framing; its digest must be the record's. Only
    segmented records are shuffled.
    """
    part = F.struct("number", "block", "total")
    single = found.where(F.col("number").isNull()).select("kind", "key", "refers", "payload_bytes", "payload_digest", F.array(part).alias("parts"))
    grouped = (
        found.where(F.col("number").isNotNull())
        .groupBy(F.coalesce("origin", "record_id").alias("whole"))
        .agg(*(F.max(c).alias(c) for c in ("key", "payload_digest")), F.array_sort(F.collect_list(part)).alias("parts"))
        .select(F.lit("response").alias("kind"), "key", F.lit(None).cast("string").alias("refers"), F.lit(None).cast("long").alias("payload_bytes"), "payload_digest", "parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                rows = batch.slice(i, 200).to_pylist()
                for r in rows:
                    _whole(r)
                names = ["kind", "key", "refers", "payload_bytes", "payload_digest", "payload"]
                kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return single.unionByName(grouped).mapInArrow(run, "kind string, key string, refers string, payload_bytes long, payload_digest string, payload binary")


def _whole(r: dict) -> None:
    r["payload"] = None
    if r["kind"] == "revisit":
        return
    parts = r["parts"]
    block = b"".join(p["block"] for p in parts)
    if len(parts) > 1 and ([p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block)):
        raise ValueError(f"segments of page {r['key']} are missing or of the wrong length")
    head, _, framed = block.partition(b"\r\n\r\n")
    r["payload"] = body = unchunked(framed) if b"transfer-encoding: chunked" in head.lower() else framed
    r["payload_bytes"] = len(body)
    if hashlib.sha256(body).hexdigest() != r["payload_digest"]:
        raise ValueError(f"page {r['key']}: its payload has another digest")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back."""
    path = shared_folder(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html", path)
    pages = reassembled(read_records(spark, path))
    return pages.select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers").cast("long").alias("refers_to")
    )


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
