"""WARC archives in which equal payloads are stored once.

Headers, not payloads, are shuffled by digest; each record whose payload another one holds becomes a
revisit of it. Revisits are written from their headers. Which pages are responses, so that their
payloads are written where they are read, a cascade of Bloom filters tells without error: the first
holds the revisits, the second the responses that pass the first, the third the revisits that pass
the second, and so on until none does. Archives are files of gzip members, one member for each
record, written by Spark's own writer, so that any store that Spark knows holds them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.llm.common import join_groups, scratch_path, written
from dyadspark.llm.exact_dedup import maybe_repeated, repeated_cells

#: A gzip member ends with the high byte of its length, which is zero below this many bytes.
MEMBER_BYTES = (1 << 24) - 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A payload of more bytes is heavy: files hold so few of these that a reader can take a file whole.
HEAVY_BYTES, HEAVY_PER_FILE = 100_000, 8
#: Filters of a cascade; each lets about a seventieth of what it is asked pass, as long as it fits an array.
MAX_FILTERS = 24
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, payload binary"


def payload_sha1(payload: Column) -> Column:
    """SHA-1 of a payload in hex; null counts as empty."""
    return F.sha1(F.coalesce(payload.cast("string").cast("binary"), F.lit(b"")))


def base32_digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_uri(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def _clean(value: str) -> str:
    """A header value: what would end its line is escaped, and so is the escape itself."""
    return "".join(f"%{ord(c):02X}" if c in "%\r\n" else c for c in value)


def _unclean(value: str) -> str:
    return value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, date: str, refers_to: int | None = None, refers_url: str | None = None, length: int | None = None) -> bytes:
    """One record, uncompressed. A revisit keeps the response's headers and leaves its payload out; length is that payload's."""
    revisit = refers_to is not None
    length = len(payload) if length is None else length
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id, url, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"X-Payload-Length: {length}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to, refers_url, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(refers_url)}")
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Fields of READ_SCHEMA from one uncompressed record; the payload of a revisit is None."""
    at = record.index(b"\r\n\r\n")
    lines = record[:at].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = record[at + 4 : at + 4 + int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("record cut short")
    kind = fields["WARC-Type"]
    payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
    # a revisit holds no payload to measure, only the length of the one it refers to
    length = int(fields["X-Payload-Length"]) if payload is None else len(payload)
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": None if page is None else int(page), "url": None if url is None else _unclean(url), "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": kind, "refers_to": None if refers is None else int(refers), "record_id": fields["WARC-Record-ID"], "payload": payload, "length_said": int(fields["X-Payload-Length"]),
    }


def zipped(record: bytes, level: int = 6) -> bytes:
    """The record as a gzip member, or as several if it has 16 MB or more; without the zero that ends the last."""
    parts = [gzip.compress(record[k : k + MEMBER_BYTES], level, mtime=0) for k in range(0, len(record), MEMBER_BYTES)]
    return b"".join(parts)[:-1]


def records_in(archive: bytes, step: int = 1 << 15) -> Iterator[bytes]:
    """The records of an archive of gzip members, fed in steps, so that no tail is copied twice."""
    view, at, held = memoryview(archive), 0, b""
    while at < len(view):
        one, out = zlib.decompressobj(31), [held]
        while not one.eof:
            if at >= len(view):
                raise ValueError("archive cut short")
            out.append(one.decompress(view[at : at + step]))
            at = min(at + step, len(view))
        at -= len(one.unused_data)
        held = b"".join(out)
        if len(held) >= record_bytes(held):
            yield held
            held = b""
    if held:
        raise ValueError("record cut short")


def record_bytes(record: bytes) -> int:
    """How long the record that begins here is."""
    at = record.index(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)$", record[:at])
    return at + 4 + int(length[1]) + 4


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Digests that occur more than once, with the record that keeps the payload.

    headers: page_id, url, sha1, payload_bytes. Result: sha1, n, keep_id, keep_url. Payloads below
    least_bytes are never shared. The smallest page_id keeps the payload; groups without any id are
    left out, so that all their records are responses.
    """
    keep = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    groups = headers.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(F.count("*").alias("n"), keep.alias("keep"))
    return groups.where("n > 1 AND keep IS NOT NULL").select("sha1", "n", F.col("keep.page_id").alias("keep_id"), F.col("keep.url").alias("keep_url"))


def in_first(first: DataFrame, second: DataFrame, key: list[str]) -> Callable[..., Column] | None:
    """A column function of the key's columns: is a row of first or second, both written and without a key in common, of first?

    None where more filters than MAX_FILTERS would be needed.
    """
    spark = first.sparkSession
    tests: list = []
    inside, outside = first, second
    while len(tests) < MAX_FILTERS:
        h = F.xxhash64(F.lit(len(tests)), *key)
        test = maybe_repeated(spark, *repeated_cells(inside.select(h.alias("h")), "h", inside.count(), 1))
        tests.append(test)
        inside, outside = written(outside.where(test(h)), "filter-passed"), inside
        if inside.isEmpty():
            break
    else:
        return None

    def of_first(*columns: Column) -> Column:
        # the first filter that stops a row tells its side
        out = F.lit(len(tests) % 2 == 1)
        for k in range(len(tests) - 1, -1, -1):
            out = F.when(~tests[k](F.xxhash64(F.lit(k), *columns)), F.lit(k % 2 == 1)).otherwise(out)
        return out

    return of_first


def _rename(spark: SparkSession, path: str, suffix: str) -> None:
    """Archives get the name that readers look for; only names change."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + suffix))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, date: str | None = None, level: int = 6, records_per_file: int = 2000) -> None:
    """Write a record per row: the row with the smallest page_id of equal payloads is a response, the others revisit it.

    Rows that repeat that page_id are responses as well. A null html is an empty payload. An empty
    table gives an empty archive folder. Payloads are written whole, in records of any length;
    columns but page_id, url and html are ignored. path must be new.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digested = rows.withColumn("sha1", payload_sha1(F.col("html"))).withColumn("payload_bytes", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long"))
    headers = written(digested.select("page_id", "url", "sha1", "payload_bytes"), "warc-headers")
    shared = written(resolve_revisits(headers, least_bytes), "warc-shared")
    total, largest = headers.agg(F.count("*"), F.coalesce(F.max("payload_bytes"), F.lit(0))).first()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, sha1, html, length, keep, keep_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(zipped(format_record(page, url, (html or "").encode(), base32_digest(sha1), date, keep, keep_url, length), level))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    columns = ["page_id", "url", "sha1", "html", "payload_bytes", "keep_id", "keep_url"]
    none = {"keep_id": F.lit(None).cast("long"), "keep_url": F.lit(None).cast("string")}
    parts: list[tuple[DataFrame, int]] = []
    responses = digested
    if not shared.isEmpty():
        known = join_groups(headers, shared, "sha1", "n", total).drop("n")
        revisit = F.col("keep_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
        known = written(known.withColumn("revisit", revisit), "warc-known")
        revisits = known.where("revisit")
        parts.append((revisits.withColumn("html", F.lit(None).cast("string")), records_per_file))
        key = ["page_id", "sha1"]
        is_revisit = in_first(written(revisits.select(*key), "warc-revisits"), written(known.where("NOT revisit").select(*key), "warc-responses"), key)
        if is_revisit is None:
            # too many revisits for filters: payloads meet their headers
            gone = revisits.select(F.xxhash64(*key).alias("__h"), F.col("page_id").alias("__page"), F.col("sha1").alias("__sha")).distinct()
            same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("sha1") == F.col("__sha"))
            responses = digested.withColumn("__k", F.xxhash64(*key)).join(gone, (F.col("__k") == F.col("__h")) & same, "left_anti").drop("__k")
        else:
            responses = digested.where(~is_revisit(F.col("page_id"), F.col("sha1")))
    responses = responses.withColumns(none)
    if largest > HEAVY_BYTES:
        heavy = F.col("payload_bytes") > HEAVY_BYTES
        parts += [(responses.where(~heavy), records_per_file), (responses.where(heavy), HEAVY_PER_FILE)]
    else:
        parts.append((responses, records_per_file))
    for some, per_file in parts:
        # the text writer puts bytes out as they are, and ends each row with the zero that zipped() left out
        packed = some.select(*columns).mapInArrow(records, "value binary")
        packed.select(F.col("value").cast("string")).write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)
    _rename(spark, path, ".warc.gz")


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives below path, with digests and lengths of payloads checked. No archive, no rows."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", *["payload"] * with_payload]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for batch in batches:
            for content in batch.column(0):
                found = []
                for record in records_in(content.as_py()):
                    fields = parse_record(record)
                    if fields["payload"] is not None and base64.b32encode(hashlib.sha1(fields["payload"]).digest()).decode() != fields["payload_digest"]:
                        raise ValueError(f"payload of {fields['record_id']} does not match its digest")
                    if fields["length_said"] != fields["payload_bytes"]:
                        raise ValueError(f"payload of {fields['record_id']} has another length than its header says")
                    found.append({n: fields[n] for n in names})
                    if len(found) == 1000:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found = []
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    schema = ", ".join(x for x in READ_SCHEMA.split(", ") if x.split()[0] in names)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives and back."""
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP8_SQL = """
WITH digests AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), groups AS (
  SELECT h, min(page_id) AS keep FROM digests GROUP BY h
)
SELECT page_id, url, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM digests JOIN groups USING (h)
"""
