import gzip
import hashlib
from base64 import b32encode

import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from dyadspark.llm.warc import OP8_SQL, format_record, op8_warc, parse_record, read_warc, records_in, write_warc, zipped
from tests.llm.helpers import SMALL, rows_of, save, sql

PAGES = [
    (5, "http://a/1", "<p>same</p>"), (3, "http://a/2?q=%0A\r\nX: y", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://b", None), (2, "http://b", ""), (4, "é", "<p>é\r\n\r\n日本</p>"), (3, "http://a/2", "<p>same</p>"),
    (None, "n", "<p>same</p>"), (None, "n", "alone"), (None, "n", "alone"), (7, "w", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (8, "z", "\x00\x1f\x8b\x08 zero\x00"),
]


def table(rows):
    return pa.Table.from_pylist([dict(zip(("page_id", "url", "html"), r, strict=True)) for r in rows], schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]))


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        keep = first.get(h or "")
        revisit = keep is not None and i != keep
        out.append((i, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


def test_query_on_awkward_rows(spark, tmp_path):
    got = op8_warc(spark, save(tmp_path, pages=table(PAGES))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == expected(PAGES)


def test_sql_twin(spark):
    assert rows_of(op8_warc(spark, SMALL)) == sql(SMALL, OP8_SQL)


def test_pages_move_by_their_headers_alone(spark, tmp_path):
    rows = [(k, f"u{k}", f"page {k % 700}" + " long" * 50) for k in range(2000)] + [(None, "n", "page 3" + " long" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit("x"), "n": F.lit(1), "keep_id": F.lit(2), "payload_bytes": F.lit("y")})
    plans = []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    write = DataFrameWriter.text

    def seen(self, *args, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **options)

    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(DataFrameWriter, "text", seen)
            write_warc(pages, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and not any("Exchange" in plan for plan in plans)
    got = read_warc(spark, str(tmp_path / "out")).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == expected(rows)


@pytest.mark.parametrize("filters", [0, 1, 24])
def test_a_cascade_of_filters_tells_without_error(spark, tmp_path, monkeypatch, filters):
    monkeypatch.setattr("dyadspark.llm.warc.MAX_FILTERS", filters)
    monkeypatch.setattr("dyadspark.llm.exact_dedup.CELLS_PER_ROW", 2)
    rows = [(k if k % 50 else None, "u", f"page {k % 400}") for k in range(1500)]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "out"))
    got = read_warc(spark, str(tmp_path / "out")).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == expected(rows)


def test_lengths_are_measured(spark, tmp_path):
    record = format_record(1, "u", b"four", "D", "2020-01-01T00:00:00Z")
    assert parse_record(record.replace(b"X-Payload-Length: 4", b"X-Payload-Length: 9"))["payload_bytes"] == 4


def test_archives_are_gzip_members_that_any_reader_opens(spark, tmp_path):
    path = str(tmp_path / "out")
    write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path, records_per_file=4)
    whole, n = 0, 0
    for file in (tmp_path / "out").glob("part-*.warc.gz"):
        data = gzip.decompress(file.read_bytes())
        records = list(records_in(file.read_bytes()))
        assert b"".join(records) == data and len(records) <= 4
        n += len(records)
        whole += sum(r.startswith(b"WARC/1.1\r\nWARC-Type: ") for r in records)
    assert n == whole == len(PAGES)
    back = {(r["page_id"], r["url"]): r for r in read_warc(spark, path, with_payload=True).collect()}
    assert back[3, PAGES[1][1]]["payload"] == b"<p>same</p>" and back[9, None]["payload"] is None and back[4, "é"]["payload"] == PAGES[5][2].encode()


def test_heavy_payloads_have_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("dyadspark.llm.warc.HEAVY_BYTES", 1000)
    monkeypatch.setattr("dyadspark.llm.warc.HEAVY_PER_FILE", 2)
    rows = [(k, "u", f"{k} " * (2000 if k % 3 == 0 else 1)) for k in range(30)] + [(99, "v", "3 " * 2000)]
    path = str(tmp_path / "out")
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    files = [len(list(records_in(f.read_bytes()))) for f in (tmp_path / "out").glob("part-*.warc.gz")]
    assert sorted(x for x in files if x) == [1, 2, 2, 2, 2, 2, 20]
    back = {r["page_id"]: r for r in read_warc(spark, path, with_payload=True).collect()}
    assert back[99]["refers_to"] == 3 and all(back[i]["payload"] == h.encode() for i, _, h in rows[:-1])


def test_short_payloads_are_not_shared(spark, tmp_path):
    path = str(tmp_path / "out")
    write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path, least_bytes=8)
    kinds = {(r["page_id"], r["payload_bytes"]): r["record_type"] for r in read_warc(spark, path).collect()}
    assert kinds[1, 0] == kinds[2, 0] == "response" and kinds[5, 11] == "revisit"


def test_records_of_sixteen_megabytes_and_more():
    payload = bytes(range(256)) * (70_000 * 4)
    record = format_record(1, "u", payload, "D", "2020-01-01T00:00:00Z")
    archive = zipped(record, 1) + b"\0" + zipped(format_record(2, "v", b"x", "E", "2020-01-01T00:00:00Z")) + b"\0"
    first, second = records_in(archive)
    assert parse_record(first)["payload"] == payload and parse_record(second)["payload"] == b"x"
    with pytest.raises(ValueError):
        list(records_in(archive[:-9]))
    with pytest.raises(ValueError):
        parse_record(record[: len(record) // 2])


def test_empty_table(spark, tmp_path):
    assert op8_warc(spark, save(tmp_path, pages=table([]))).collect() == []
