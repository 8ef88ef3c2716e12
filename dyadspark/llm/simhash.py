"""SimHash near-duplicates with BK-trees.

Fingerprints that differ in at most four bits agree on all but four of five or more blocks of bits,
so each distinct fingerprint is dealt to one bucket for each choice of such blocks. A task builds a
BK-tree for each of its buckets (a child hangs on the edge numbered by its Hamming distance to the
parent) and looks every fingerprint of the bucket up in it, following only edges within the radius.
Trees of all buckets grow and are searched level by level in one pass over arrays. A bucket gives
back a spanning forest, not its pairs, so that dense groups stay small.

A tree broadcast to all tasks would have to hold all fingerprints, whose number grows with the
corpus; by the blocks, a tree meets only fingerprints that can be near it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.llm.common import join_groups, written
from dyadspark.llm.components import connected_components

#: A bucket of more fingerprints is cut into shards, and each two shards meet in a task of their own.
TREE_LIMIT = 20_000
#: Fingerprints are cut into more blocks, and meet in more and narrower buckets, until a bucket holds so many on average.
BUCKET_MEAN = 512


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles of a text in UTF-8, A-Z lower-cased, in order; none for a text without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(flat, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    first = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    return np.fromiter((digest(flat[a:b], seed) for a, b in zip(first, ends[shingle - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(first))


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits, highest first, that over half of the hashes have."""
    votes = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 14):
        some = hashes[low : low + (1 << 14)].astype(">u8")
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * votes > len(hashes)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text in UTF-8, A-Z lower-cased, repeats included."""
    return int.from_bytes(np.packbits(majority(shingle_hashes(text, shingle, seed))).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; null texts are empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t.as_py() or b"", shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")).mapInArrow(rows, "doc_id long, fp long")


class Forest:
    """A BK-tree for each bucket. fps: the members as rows of 64-bit words, bucket by bucket; bucket: its number, ascending."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray):
        self.fps, n = fps if fps.ndim == 2 else fps[:, None], len(bucket)
        self.bits = 64 * self.fps.shape[1]
        first = np.concatenate(([True], bucket[1:] != bucket[:-1])) if n else np.empty(0, dtype=bool)
        self.root_of = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.empty(0, dtype=np.int64)
        slots, nodes = [], []
        left = np.flatnonzero(~first)
        at = self.root_of[left]
        while len(left):
            # the first fingerprint at a distance from the node becomes its child there
            slot = at * (self.bits + 1) + self.distance(left, at)
            order = np.argsort(slot, kind="stable")
            left, slot = left[order], slot[order]
            head = np.concatenate(([True], slot[1:] != slot[:-1]))
            nodes.append(left[head])
            slots.append(slot[head])
            at = left[head][np.cumsum(head) - 1][~head]
            left = left[~head]
        child = np.concatenate(nodes) if nodes else np.empty(0, dtype=np.int64)
        slot = np.concatenate(slots) if slots else child
        order = np.argsort(slot, kind="stable")
        self.slot, self.child = slot[order], child[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fps[a] ^ self.fps[b]).sum(axis=1, dtype=np.int64)

    def links(self, radius: int, block: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members of one bucket within the radius, each once. At most about block of them are looked at at once."""
        yield from self._search(radius, np.ones(len(self.fps), dtype=bool), block)

    def joining(self, radius: int, block: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Enough of links() to join what they join.

        In each bucket the members around a hub, the best of three, are tied to it and not looked up;
        the others are looked up among all. So a dense bucket takes one step for each member. Where
        the radius is so wide that a lookup would follow nearly all edges, the bucket is scanned.
        """
        n = len(self.fps)
        if not n:
            return
        every = np.arange(n)
        first = np.flatnonzero(self.root_of == every)
        size = np.diff(np.append(first, n))
        hub, tied, most = self.root_of, np.zeros(n, dtype=bool), np.full(len(first), -1)
        for part in range(3):
            pick = np.repeat(first + size * part // 3, size)
            near = self.distance(every, pick) <= radius
            found = np.add.reduceat(near.astype(np.int64), first)
            better = np.repeat(found > most, size)
            hub, tied, most = np.where(better, pick, hub), np.where(better, near, tied), np.maximum(most, found)
        yield every[tied], hub[tied]
        asked, away = ~tied, self.distance(every, hub)
        for low, n in zip(first[size > 64].tolist(), size[size > 64].tolist(), strict=True):
            own = away[low : low + n]
            query = np.flatnonzero(asked[low : low + n])
            steps = np.sort(own)
            followed = np.searchsorted(steps, own[query] + radius, side="right") - np.searchsorted(steps, own[query] - radius)
            if followed.sum() > 0.9 * n * len(query):
                asked[low : low + n] = False
                yield from self._scan(radius, low, n, query + low, block)
        yield from self._search(radius, asked, block)

    def _scan(self, radius: int, low: int, n: int, members: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        all_ = np.ascontiguousarray(self.fps[low : low + n].T)
        step = max(1, block // n)
        for at in range(0, len(members), step):
            query = members[at : at + step]
            d = np.zeros((len(query), n), dtype=np.uint16)
            for word, own in zip(all_, self.fps[query].T, strict=True):
                d += np.bitwise_count(own[:, None] ^ word)
            a, b = np.nonzero(d <= radius)
            a, b = query[a], b + low
            yield a[a != b], b[a != b]

    def _search(self, radius: int, asked: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        members = np.flatnonzero(asked)
        for low in range(0, len(members), block):
            query = members[low : low + block]
            waiting = [(query, self.root_of[query], np.ones(len(query), dtype=np.int64), True)]
            while waiting:
                query, a, n, roots = waiting.pop()
                upto = np.cumsum(n)
                if len(query) > 1 and upto[-1] > block:
                    half = min(max(1, int(np.searchsorted(upto, upto[-1] // 2))), len(query) - 1)
                    waiting += [(query[half:], a[half:], n[half:], roots), (query[:half], a[:half], n[:half], roots)]
                    continue
                at = np.repeat(a - upto + n, n) + np.arange(int(upto[-1]))
                node = at if roots else self.child[at]
                query = np.repeat(query, n)
                d = self.distance(query, node)
                hit = (d <= radius) & ((node < query) | ~asked[node])
                if hit.any():
                    yield query[hit], node[hit]
                base = node * (self.bits + 1)
                a = np.searchsorted(self.slot, base + np.maximum(d - radius, 0), side="left")
                n = np.searchsorted(self.slot, base + np.minimum(d + radius, self.bits), side="right") - a
                some = n > 0
                if some.any():
                    waiting.append((query[some], a[some], n[some], False))


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member that each of n members reaches over the pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(root, high, low)
            while not np.array_equal(root, after := root[root]):
                root = after
    return root


def whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Sorted batches as tables of at least so many rows that never part the rows of one value in the first column."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= least:
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


def _near(radius: int):
    """Rows (bucket, node, words of the fingerprint), sorted by bucket, to edges (a, b) between nodes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1 << 15):
            cells, node = table.column(0).to_numpy(), table.column(1).to_numpy()
            fps = np.stack([table.column(k).to_numpy() for k in range(2, table.num_columns)], axis=1).view(np.uint64)
            bucket = np.cumsum(np.concatenate(([0], (cells[1:] != cells[:-1]).astype(np.int64))))
            root = spanning(len(node), Forest(fps, bucket).joining(radius))
            tied = root != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[root[tied]])], names=["a", "b"])

    return rows


def deal(rows: DataFrame, large: DataFrame, total: int) -> DataFrame:
    """rows with bucket in place of cell, so that any two rows of a cell share a bucket, and no bucket is large.

    rows: cell and more; large: cell, n (its rows) and shards (over 1), written. A row of a large
    cell is in one of its shards; each two shards meet in a bucket of their own.
    """
    rest = [c for c in rows.columns if c != "cell"]
    if large.isEmpty():
        return rows.select(F.col("cell").alias("bucket"), *rest)
    tagged = join_groups(rows, large, "cell", "n", total)
    x, y = F.pmod(F.xxhash64("node"), F.col("shards")), F.col("__y")
    spread = tagged.where("shards IS NOT NULL").select("cell", *rest, x.alias("__x"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("__y"))
    split = spread.select(F.xxhash64("cell", F.least("__x", y), F.greatest("__x", y)).alias("bucket"), *rest)
    return tagged.where("shards IS NULL").select(F.col("cell").alias("bucket"), *rest).unionByName(split)


def bucket_links(dealt: DataFrame, near: Callable, total: int, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """Edges (a, b) that near() finds between the nodes of a cell, none of which meets more than tree_limit others at once.

    dealt: cell, node and what near() reads, all longs; total: its rows.
    """
    large = dealt.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > tree_limit).withColumn("shards", F.ceil(F.col("n") / (tree_limit / 2)).cast("int"))
    parts = deal(dealt, written(large, "large-buckets"), total)
    return parts.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(near, "a long, b long").distinct()


def block_keys(fp: Column, radius: int, rows: int) -> list[Column]:
    """Keys of which fingerprints within the radius share at least one: all choices of all but radius blocks of bits."""
    for blocks in range(radius + 1, radius + 6):
        cuts = [64 * k // blocks for k in range(blocks + 1)]
        if rows >> ((64 // blocks) * (blocks - radius)) <= BUCKET_MEAN:
            break
    parts = [F.shiftrightunsigned(F.shiftleft(fp, cuts[k]), 64 - cuts[k + 1] + cuts[k]) for k in range(blocks)]
    return [F.xxhash64(F.lit(k), *[parts[p] for p in chosen]) for k, chosen in enumerate(combinations(range(blocks), blocks - radius))]


def fingerprint_links(fps: DataFrame, radius: int = 4, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """Edges (a, b) that join all fingerprints within radius of each other, directly or by way of others.

    fps: distinct signed longs in column fp, written.
    """
    rows = fps.count()
    keys = block_keys(F.col("fp"), radius, rows)
    dealt = fps.select(F.explode(F.array(*keys)).alias("cell"), F.col("fp").alias("node"), "fp")
    return bucket_links(dealt, _near(radius), rows * len(keys), tree_limit)


def near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link where their fingerprints differ in at most radius bits; component_id is the
    smallest id that links reach, a document's own included (null where all ids of it are). Texts
    without words have fingerprint zero and link like any other.
    """
    table = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = written(table.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct-fingerprints")
    links = fingerprint_links(groups.select("fp"), radius)
    parts = connected_components(links)
    linked = groups.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    classes = written(linked.select("fp", "first_id", "n", "component"), "fingerprint-classes")
    # most classes hold one fingerprint; a class's smallest id is a plain minimum, taken before it moves
    least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    named = join_groups(classes, written(least, "class-ids"), "component", "members", groups.count(), "inner")
    answers = written(named.select("fp", "component_id", "n"), "fingerprint-answers")
    joined = join_groups(table, answers, "fp", "n", table.count(), "inner")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
