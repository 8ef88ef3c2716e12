"""Minimum bin slack packing of tokenised documents into fixed windows.

Whole windows are cut off long documents as they come; what is left of them, and the short ones,
form a multiset of lengths. A window starts with the longest piece. A subset-sum over the
remaining multiset, one bit for each reachable fill, then finds the pieces that come closest to the
capacity, and walking back through its steps gives how many of each length to take.

Each task packs the documents of its own input split, so nothing is shuffled. It holds a bounded
buffer of ids and packs it whenever it is full, keeping enough pieces back for a rich choice.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.llm.common import give_back
from dyadspark.llm.tokens import default_tokenizer, encoder

#: Words that an encoder remembers here: fewer than shards do, as pieces are held as well.
CACHE_WORDS = 150_000
Piece = tuple  # doc_id, start, ids as bytes, tokens of the document


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum not over capacity of a sub-multiset, and how many of each length make it.

    lengths: the distinct ones, tried from the end on. Copies of one length are tried in blocks of
    1, 2, 4, ..., and the search ends once capacity itself is reachable.
    """
    within = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in reversed(lengths):
        left, block = min(counts[length], capacity // length), 1
        while left > 0:
            block = min(block, left)
            after = reach | (reach << (block * length)) & within
            if after != reach:
                steps.append((reach, length, block))
                reach = after
            left -= block
            block *= 2
        if reach >> capacity & 1:
            break
    total = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, block in reversed(steps):
        if not before >> at & 1:
            at -= block * length
            used[length] = used.get(length, 0) + block
    return total, used


class Packer:
    """Packs pieces into sequences; add() and close() return (sequence, offset, piece) as they fill."""

    def __init__(self, capacity: int, buffer_tokens: int = 1 << 20, reserve: int = 64):
        self.capacity, self.buffer_tokens, self.keep = capacity, buffer_tokens, reserve * capacity
        self.by_length: dict[int, list[Piece]] = {}
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.held = self.sequence = 0

    def _put(self, piece: Piece) -> None:
        n = len(piece[2]) // 4
        if not self.counts.get(n):
            insort(self.lengths, n)
            self.by_length.setdefault(n, [])
        self.by_length[n].append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.held += n

    def _take(self, n: int) -> Piece:
        piece = self.by_length[n].pop()
        self.counts[n] -= 1
        if not self.counts[n]:
            self.lengths.pop(bisect_left(self.lengths, n))
            del self.counts[n], self.by_length[n]
        self.held -= n
        return piece

    def _window(self, size: int, cut: bool) -> list[tuple]:
        """One sequence of at most size ids; exactly size if pieces may be cut."""
        chosen: list[Piece] = []
        room = size
        if self.lengths[-1] <= size:
            chosen.append(self._take(self.lengths[-1]))
            room -= len(chosen[0][2]) // 4
        top = bisect_left(self.lengths, room + 1)
        _, used = fullest(self.lengths[:top], self.counts, room)
        for length, n in used.items():
            for _ in range(n):
                chosen.append(self._take(length))
                room -= length
        if room and cut:
            # no piece that is left fits: part of the longest fills the window
            doc, start, ids, tokens = self._take(self.lengths[-1])
            chosen.append((doc, start, ids[: 4 * room], tokens))
            self._put((doc, start + room, ids[4 * room :], tokens))
        out, offset = [], 0
        for piece in chosen:
            out.append((self.sequence, offset, piece))
            offset += len(piece[2]) // 4
        self.sequence += 1
        return out

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        tokens, step = len(ids) // 4, 4 * self.capacity
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            yield self.sequence, 0, (doc_id, at // 4, ids[at : at + step], tokens)
            self.sequence += 1
        if whole < len(ids):
            self._put((doc_id, whole // 4, ids[whole:], tokens))
        if self.held >= self.buffer_tokens:
            while self.held >= self.keep + self.capacity:
                yield from self._window(self.capacity, cut=True)

    def close(self) -> Iterator[tuple]:
        """Full windows while they last; the rest as sequences of powers of two, which need no padding."""
        while self.held >= self.capacity:
            yield from self._window(self.capacity, cut=True)
        while self.held:
            yield from self._window(1 << (self.held.bit_length() - 1), cut=True)


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document's ids, with end_id appended, lie in exactly one piece each; a null text is just
    end_id. Sequences hold capacity ids; the last ones of an input split hold powers of two. Rows
    that repeat are packed as often as they come, and null ids are kept; an empty table gives no
    rows; texts are encoded whole, however long; other columns are ignored. cache_words: words that
    a worker remembers.
    """
    tokenizer = tokenizer or default_tokenizer()
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, cache_words), np.array([end_id], dtype="<u4").tobytes()
        packer, base = Packer(capacity), TaskContext.get().partitionId() << 32

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = [[p[0] for _, _, p in found], [p[1] for _, _, p in found], [len(p[2]) // 4 for _, _, p in found], [zlib.crc32(p[2]) for _, _, p in found], [p[3] for _, _, p in found], [base + s for s, _, _ in found], [o for _, o, _ in found]]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                arrays.append(pa.array([p[2] for _, _, p in found], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

        for batch in batches:
            found: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.documents(batch.column(1)), strict=True):
                found += packer.add(doc_id, ids + end)
            if found:
                yield rows(found)
        if found := list(packer.close()):
            yield rows(found)
        give_back()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(pieces, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
