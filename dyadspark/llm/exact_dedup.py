"""Exact deduplication behind a two-pass Bloom filter.

Pass one marks, for two cells of a bit array per hash, whether they were hit, and whether they were
hit again. Each task marks those of its own rows, and what the tasks hand over are the cells they
hit; no row moves. Pass two looks every row up: if one of its cells was hit once, its text occurs
once and the row goes straight through. Only the other rows, the repeated ones and a small share of
false alarms, are shuffled and compared by their SHA-256. Where the rows are too many for one array,
each range of hashes has its own, so that the share of false alarms is the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.llm.common import ascii_lower, join_groups, scratch_path, written

#: Cells for each row: a text that occurs once is taken for a repeated one in about 1.4 % of cases.
CELLS_PER_ROW = 16
#: An array is broadcast, so its size is bounded: 2**30 cells, 128 MB, for 67 million rows.
MAX_CELLS_LOG2 = 30
#: Cells travel by chunks of so many (in bits); a task hands over what it hit after so many.
_CHUNK, _HELD = 16, 1 << 19


def text_sha256(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, in hex; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), 256)


def _cells(h: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Two cells of each hash."""
    x = h.astype(np.int64, copy=False).view(np.uint64)
    return (x & np.uint64((1 << log2) - 1)).astype(np.int64), ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - log2)).astype(np.int64)


def repeated_cells(hashes: DataFrame, column: str, rows: int, least: int = 2) -> tuple[np.ndarray, int]:
    """Bits of the cells that were hit at least so often (once or twice), and log2 of their number.

    Beyond 2**MAX_CELLS_LOG2 cells the array does not grow: more cells are hit, and none is missed.
    """
    log2 = min(MAX_CELLS_LOG2, max(10, (CELLS_PER_ROW * max(rows, 1) - 1).bit_length()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            chunk, again = cells >> _CHUNK, n > 1
            starts = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
            offsets = (cells & ((1 << _CHUNK) - 1)).astype("<u2")
            ends = [*starts[1:].tolist(), len(cells)]
            seen = [offsets[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)]
            more = [offsets[a:b][again[a:b]].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(chunk[starts]), pa.array(seen, pa.binary()), pa.array(more, pa.binary())], names=["chunk", "seen", "again"])

        for batch in batches:
            if len(batch):
                held += _cells(batch.column(0).to_numpy(), log2)
            if sum(map(len, held)) >= _HELD:
                yield flush()
        if held:
            yield flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, again = None, np.zeros(1 << _CHUNK, dtype=bool), np.zeros(1 << _CHUNK, dtype=bool)

        def bits() -> pa.RecordBatch:
            found = np.packbits(seen if least < 2 else again, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([found], pa.binary())], names=["chunk", "bits"])

        for batch in batches:
            for chunk, new, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if chunk != at:
                    if at is not None:
                        yield bits()
                    at = chunk
                    seen[:] = again[:] = False
                x = np.frombuffer(new.as_py(), "<u2")
                again[x[seen[x]]] = True
                again[np.frombuffer(more.as_py(), "<u2")] = True
                seen[x] = True
        if at is not None:
            yield bits()

    parts = hashes.select(F.col(column)).where(F.col(column).isNotNull()).mapInArrow(part, "chunk long, seen binary, again binary")
    out = np.zeros(max(1, (1 << log2) // 8), dtype=np.uint8)
    for row in parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merged, "chunk long, bits binary").toLocalIterator():
        some = np.frombuffer(row["bits"], dtype=np.uint8)
        low = row["chunk"] << (_CHUNK - 3)
        out[low : low + len(some)] = some[: len(out) - low]
    return out, log2


def maybe_repeated(spark: SparkSession, bits: np.ndarray, log2: int):
    """A column function: may the hash be among those that filled the cells?"""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        b, out = shared.value, np.ones(len(h), dtype=bool)
        for cell in _cells(h.to_numpy(dtype=np.int64), log2):
            out &= (b[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
        return pd.Series(out)

    return test


def mark_repeated(table: DataFrame, rows: int) -> DataFrame:
    """table with maybe, whether its hash h may occur again. table: written, sorted by h within its files.

    Each range of hashes is marked with its own array; a range reads the pages of the files that hold it.
    """
    spark = table.sparkSession
    ranges = 1
    while CELLS_PER_ROW * rows > ranges << MAX_CELLS_LOG2:
        ranges *= 2
    if ranges == 1:
        return table.withColumn("maybe", maybe_repeated(spark, *repeated_cells(table, "h", rows))("h"))
    path, width = scratch_path(spark, "marked-hashes"), (1 << 64) // ranges
    for k in range(ranges):
        low = -(1 << 63) + k * width
        part = table.where((F.col("h") >= low) & (F.col("h") <= low + width - 1))
        test = maybe_repeated(spark, *repeated_cells(part, "h", rows // ranges))
        part.withColumn("maybe", test("h")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    largest id stays (a null id only where all are null); of rows that share that id as well, one.
    An empty table gives no rows; texts are hashed whole, however long; other columns are ignored.
    """
    sha = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_sha256(F.col(text_col)).alias("text_sha256"))
    table = written(sha.withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64("text_sha256")}).sortWithinPartitions("h"), "text-hashes")
    total = table.count()
    marked = mark_repeated(table, total)
    once = marked.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = marked.where("maybe").select("doc_id", "text_sha256", "row")
    groups = again.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    joined = join_groups(again, written(groups, "equal-texts"), "text_sha256", "group_size", total)
    return once.unionByName(joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, chosen as in exact_duplicates(); all columns stay.

    Texts that do repeat are found on their hashes first; only their rows, and a small share of
    others while those fit one array, are shuffled as a whole.
    """
    spark = docs.sparkSession
    sha = text_sha256(F.col(text_col))
    hashes = written(docs.select(F.xxhash64(sha).alias("h")).sortWithinPartitions("h"), "text-hashes")
    repeated = written(mark_repeated(hashes, hashes.count()).where("maybe").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-hashes")
    test = maybe_repeated(spark, *repeated_cells(repeated, "h", repeated.count(), 1))
    marked = docs.select(F.struct("*").alias("row"), sha.alias("sha"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie")).withColumn("maybe", test(F.xxhash64("sha")))
    once = marked.where(~F.col("maybe")).select("row")
    again = marked.where("maybe").groupBy("sha").agg(F.max_by("row", F.struct("id", "tie")).alias("row")).select("row")
    return once.unionByName(again).select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
WITH hashed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), grouped AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256
)
SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id = g.keep_id AS kept, h.text_sha256 FROM hashed h JOIN grouped g USING (text_sha256)
"""
