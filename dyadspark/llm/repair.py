"""Token shards under Re-Pair grammar compression.

A shard holds whole documents. Its ids are rewritten in rounds: each round counts neighbouring
pairs within documents, gives the frequent ones a nonterminal each and replaces their occurrences
that don't overlap, from the left. Rules and the lengths they expand to are stored, so that any
range of any document is decoded without the rest of the shard.

Layout, little-endian: magic, n_docs, n_tokens, n_symbols, n_rules, base, width (7 unsigned 64-bit
integers); doc_id int64 [n_docs]; doc_id is null uint8 [n_docs]; tokens uint64 [n_docs]; end of the
document's symbols uint64 [n_docs]; rules uint32 [n_rules, 2]; lengths uint32 [n_rules]; symbols of
width bytes [n_symbols]. Symbols from base on are nonterminals; a rule names earlier symbols only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadspark.llm.common import scratch_path, small_batches
from dyadspark.llm.tokens import default_tokenizer, encoder

MAGIC = 0x31725061506552
#: Below 2**16, symbols take two bytes; vocabularies that leave less room for rules than LEAST_RULES take four.
NARROW, LEAST_RULES = 1 << 16, 1 << 12
SHARD_SCHEMA = "shard long, n_docs long, n_tokens long, n_symbols long, n_rules long, blob binary"


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = 12, rounds: int = 8, max_rules: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, ends of the documents in them, and rules.

    least: occurrences that a pair needs. max_rules: by default as many as two-byte symbols allow,
    and as many as those could name where symbols take four bytes.
    """
    if max_rules is None:
        max_rules = NARROW - base if base <= NARROW - LEAST_RULES else NARROW
    room = max_rules
    # symbols of two bytes make keys of four, which sort in half the time
    kind, wide, half = (np.uint16, np.uint32, 16) if base + room <= NARROW else (np.uint32, np.uint64, 32)
    mix, shift = (wide(0x9E3779B1), wide(12)) if half == 16 else (wide(0x9E3779B97F4A7C15), wide(44))
    seq = ids.astype(kind)
    last = np.zeros(len(seq), dtype=bool)
    last[ends[ends > 0] - 1] = True
    counts = np.diff(ends, prepend=0)
    rules = np.empty((0, 2), dtype=np.int64)
    slots = np.empty(1 << 20, dtype=np.int32)
    for _ in range(rounds):
        if len(seq) < 2 or not room:
            break
        key = (seq[:-1].astype(wide) << wide(half)) | seq[1:]
        inside = ~last[:-1]
        order = np.sort(key[inside])
        if len(order) < least:
            break
        # a pair that occurs least times fills a stretch of the sorted keys
        far = np.flatnonzero(order[least - 1 :] == order[: len(order) - least + 1])
        pairs = np.unique(order[far])
        if not len(pairs):
            break
        n = np.searchsorted(order, pairs, side="right") - np.searchsorted(order, pairs, side="left")
        # a round takes the frequent ones only: what they leave is counted again in the next
        kept = n >= max(least, int(n.max()) // 256)
        pairs, n = pairs[kept], n[kept]
        if len(pairs) > room:
            best = np.sort(np.lexsort((pairs, -n))[:room])
            pairs, n = pairs[best], n[best]
        # pairs whose slot a more frequent pair has wait for a later round
        slots.fill(-1)
        rank = np.argsort(n, kind="stable")
        slots[((pairs * mix) >> shift)[rank]] = rank
        rule = slots[(key * mix) >> shift]
        at = np.flatnonzero((rule >= 0) & inside)
        rule = rule[at]
        hit = pairs[rule] == key[at]
        at, rule = at[hit], rule[hit]
        # of neighbouring hits every second one is replaced
        run = np.concatenate(([True], np.diff(at) != 1))
        place = np.arange(len(at))
        odd = (place - np.maximum.accumulate(np.where(run, place, 0))) & 1
        at, rule = at[odd == 0], rule[odd == 0]
        used = np.bincount(rule, minlength=len(pairs))
        worth = used >= max(2, least // 3)
        at, rule = at[worth[rule]], rule[worth[rule]]
        if not len(at):
            break
        renamed = np.cumsum(worth) - 1 + base + len(rules)
        seq[at] = renamed[rule]
        stays = np.ones(len(seq), dtype=bool)
        stays[at + 1] = False
        last[at] = last[at + 1]
        seq, last = seq[stays], last[stays]
        new = pairs[worth]
        rules = np.concatenate((rules, np.stack((new >> wide(half), new & wide((1 << half) - 1)), axis=1).astype(np.int64)))
        room -= len(new)
    symbol_ends = np.zeros(len(counts), dtype=np.int64)
    if len(counts):
        # empty documents end where the one before them does
        where = np.flatnonzero(last) + 1
        symbol_ends = np.concatenate(([0], where))[np.cumsum(counts > 0)]
    return seq, symbol_ends, rules


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((1 if a < base else out[a - base]) + (1 if b < base else out[b - base]))
    return np.array(out, dtype=np.uint32)


def pack(doc_ids: list[int | None], docs: list[bytes], base: int) -> tuple[bytes, dict]:
    """A shard of documents, each as little-endian unsigned 32-bit ids."""
    tokens = np.array([len(d) // 4 for d in docs], dtype=np.uint64)
    ids = np.frombuffer(b"".join(docs), dtype="<u4")
    base = max(base, int(ids.max(initial=0)) + 1)
    symbols, ends, rules = compress(ids, np.cumsum(tokens).astype(np.int64), base)
    width = 2 if base + len(rules) <= NARROW else 4
    head = np.array([MAGIC, len(docs), len(ids), len(symbols), len(rules), base, width], dtype="<u8")
    parts = [head, np.array([d or 0 for d in doc_ids], dtype="<i8"), np.array([d is None for d in doc_ids], dtype="u1"), tokens.astype("<u8"), ends.astype("<u8"), rules.astype("<u4"), lengths_of(rules, base).astype("<u4"), symbols.astype(f"<u{width}")]
    return b"".join(p.tobytes() for p in parts), {"n_docs": len(docs), "n_tokens": len(ids), "n_symbols": len(symbols), "n_rules": len(rules)}


class Shard:
    """A packed shard, opened for random access."""

    def __init__(self, blob: bytes):
        magic, self.n_docs, self.n_tokens, n_symbols, n_rules, self.base, width = np.frombuffer(blob, "<u8", 7).tolist()
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.tokens = take("<u8", self.n_docs).astype(np.int64)
        self.ends = take("<u8", self.n_docs).astype(np.int64)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        self.symbols = take(f"<u{width}", n_symbols)
        self.grown: list[bytes] | None = None

    def _expansions(self) -> list[bytes]:
        if self.grown is None:
            word = np.arange(self.base, dtype="<u4").tobytes()
            out = [word[i : i + 4] for i in range(0, len(word), 4)]
            for a, b in self.rules.tolist():
                out.append(out[a] + out[b])
            self.grown = out
        return self.grown

    def _symbols(self, k: int) -> np.ndarray:
        return self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]]

    def document(self, k: int) -> bytes:
        """The ids of the k-th document, as bytes."""
        return b"".join(map(self._expansions().__getitem__, self._symbols(k).tolist()))

    def span(self, k: int, start: int, length: int) -> np.ndarray:
        """length ids of the k-th document from start on; only symbols that cover them are expanded."""
        symbols = self._symbols(k).astype(np.int64)
        size = np.ones(len(symbols), dtype=np.int64)
        inner = symbols >= self.base
        size[inner] = self.lengths[symbols[inner] - self.base]
        upto = np.cumsum(size)
        stop = min(start + length, int(upto[-1]) if len(upto) else 0)
        if start >= stop:
            return np.empty(0, dtype=np.uint32)
        a, b = np.searchsorted(upto, start, side="right"), np.searchsorted(upto, stop, side="left")
        out: list[int] = []
        for s in symbols[a : b + 1].tolist():
            stack = [s]
            while stack:
                x = stack.pop()
                if x < self.base:
                    out.append(x)
                else:
                    left, right = self.rules[x - self.base].tolist()
                    stack += [right, left]
        skip = start - int(upto[a] - size[a])
        return np.array(out[skip : skip + stop - start], dtype=np.uint32)


def write_token_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id to it, and write shards in ascending id order.

    The documents are dealt into ranges of ids (texts of one id over several tasks), and each task
    writes shards of about shard_tokens ids. Shards are rows of Parquet, so that any store that
    Spark writes to holds them and lost tasks are repeated. Null ids come first; null texts are
    empty; rows of equal ids are ordered by text.
    """
    tokenizer = tokenizer or default_tokenizer()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        rows: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            blob, info = pack(ids, rows, encode.vocab_size)
            out = pa.RecordBatch.from_pylist([{"shard": (part << 24) + seq, **info, "blob": blob}], schema=pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_symbols", pa.int64()), ("n_rules", pa.int64()), ("blob", pa.binary())]))
            seq, held = seq + 1, 0
            ids.clear()
            rows.clear()
            return out

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), encode.documents(batch.column(1)), strict=True):
                row = found + end
                ids.append(doc_id)
                rows.append(row)
                held += len(row) // 4
                if held >= shard_tokens:
                    yield flush()
        if rows:
            yield flush()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = narrow.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").mapInArrow(shards, SHARD_SCHEMA).write.parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard and base, the ids of all shards before it: sums by task first, then within a task."""
    sizes = spark.read.parquet(path).select("shard", "n_tokens", F.shiftright("shard", 24).alias("part"))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("inner", inner).join(before, "part").select("shard", (F.col("before") + F.col("inner")).alias("base"))


def read_token_shards(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids as bytes."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(blob.as_py())
                starts = (np.cumsum(shard.tokens) - shard.tokens).tolist()
                for low in range(0, shard.n_docs, 4096):
                    some = range(low, min(low + 4096, shard.n_docs))
                    got = [shard.document(k) for k in some]
                    columns = {"shard": [number] * len(got), "doc_id": shard.doc_ids[low : low + 4096], "inner": starts[low : low + 4096], "n_tokens": [len(x) // 4 for x in got], "ids_crc32": [zlib.crc32(x) for x in got]}
                    arrays = [pa.array(v, pa.int64()) for v in columns.values()]
                    if with_ids:
                        arrays.append(pa.array(got, pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *["ids"] * with_ids])

    schema = "shard long, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = spark.read.parquet(path).select("shard", "blob").mapInArrow(documents, schema)
    joined = rows.join(shard_starts(spark, path), "shard")
    return joined.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "shard", *["ids"] * with_ids)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the file format and back."""
    small_batches(spark, 1000)  # words are looked up once a batch
    path = scratch_path(spark, "token-shards")
    write_token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_shards(spark, path)
