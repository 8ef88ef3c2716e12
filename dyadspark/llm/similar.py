"""Near-duplicates by the share of word shingles that two documents have in common.

SimHash finds the candidates, an exact comparison decides. A document's sketch is a fingerprint of
several words and a few seeds, the least of its shingles in as many orders. Documents that share a
seed meet in a bucket, where those that share more seeds are looked up in BK-trees if it is large;
what lies within the radius is a candidate. The candidates' connected groups are small, and there
the shingles themselves, as 64-bit hashes, are compared for all that share a seed. Copies with the
same set of shingles, by a hash of 128 bits, count as one throughout, and groups give back spanning
forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.common import drop_held, give_back, join_groups, written
from dyadspark.llm.components import connected_components
from dyadspark.llm.exact_dedup import maybe_repeated, repeated_cells
from dyadspark.llm.simhash import Forest, bucket_links, deal, majority, shingle_hashes, spanning, whole_groups

#: 64-bit words of a fingerprint, and seeds: of two documents with four fifths in common, all but one in 200,000 pairs share three seeds or more.
WORDS, SEEDS = 4, 12
#: Deviations that the radius allows for: one link in a million at the similarity itself lies beyond it.
DEVIATIONS = 5
#: A bucket of more documents is parted by further seeds, as long as that makes it smaller.
LEAF = 256
#: A group of candidates with more documents, or more shingles in all, is cut up before it is compared.
GROUP_DOCS, GROUP_SHINGLES = 20_000, 1_500_000
#: Buckets of more documents than a task should hold are cut into shards.
BUCKET_LIMIT = 200_000


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of well-mixed functions of 64-bit hashes."""
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sketch(text: bytes, shingle: int) -> tuple[bytes, list[int], list[int], bytes]:
    """A hash of the set of shingles, fingerprint words, seeds, and the set as sorted 64-bit hashes."""
    h = np.unique(shingle_hashes(text, shingle))
    if not len(h):
        return bytes(16), [0] * WORDS, [0] * SEEDS, b""
    words = [int(np.packbits(majority(_mixed(h, k + 1))).view(">i8")[0]) for k in range(WORDS)]
    seeds = [int(_mixed(h, WORDS + k + 1).min().view(np.int64)) for k in range(SEEDS)]
    whole = h.astype("<u8").tobytes()
    return xxhash.xxh3_128_digest(whole), words, seeds, whole


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, set_hash, size, f0.., s0.., shingles of every row; a null text is empty."""
    names = ["size", *[f"f{k}" for k in range(WORDS)], *[f"s{k}" for k in range(SEEDS)]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            found = [sketch(t.as_py() or b"", shingle) for t in batch.column(2)]
            longs = np.array([[len(whole) // 8, *words, *seeds] for _, words, seeds, whole in found], dtype=np.int64).reshape(-1, len(names))
            ends = [pa.array([x[k] for x in found], pa.binary()) for k in (0, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(longs[:, k]) for k in range(len(names))], *ends], names=["doc_id", "text_hash", *names, "set_hash", "shingles"])

    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    return chosen.mapInArrow(rows, ", ".join(f"{n} long" for n in ["doc_id", "text_hash", *names]) + ", set_hash binary, shingles binary")


def leaves(bucket: np.ndarray, seeds: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and the leaf that each is in, ascending. A row may be in several leaves; one that is alone is in none.

    bucket: its number by row; seeds: rows x seeds; last: the seed that made the bucket. A large
    bucket is parted by each later seed, and what is still large once more; one that a seed leaves
    mostly whole holds copies and is a leaf. In large ones without a later seed, documents that share
    another seed have met before.
    """
    row, group, at = np.arange(len(bucket)), bucket.astype(np.int64), last.astype(np.int64)
    rows, names = [], []

    def put(some: np.ndarray) -> None:
        rows.append(row[some])
        names.append(group[some] + 1 + max((int(x.max(initial=-1)) for x in names), default=-1))

    for depth in (1, 2, 3):
        size = np.bincount(group)[group] if len(group) else group
        large = (size > LEAF) & (depth < 3)
        put(~large & (size > 1))
        if not large.any():
            break
        parts = []
        for k in range(1, seeds.shape[1]):
            some = np.flatnonzero(large & (at < k))
            key = _mixed((group[some] * seeds.shape[1] + k).view(np.uint64), 0) ^ seeds[row[some], k].astype(np.uint64)
            _, inner, n = np.unique(key, return_inverse=True, return_counts=True)
            parts.append((row[some], group[some], np.full(len(some), k), key, n[inner], 2 * n[inner] > size[some]))
        row_, parent, at_, key, n, most = (np.concatenate(x) for x in zip(*parts, strict=True))
        dense = np.unique(parent[most])
        put(large & np.isin(group, dense))
        go = (n > 1) & ~np.isin(parent, dense)
        row, at = row_[go], at_[go]
        group = np.unique(key[go], return_inverse=True)[1]
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.argsort(name, kind="stable")
    return row[order], name[order]


def _near(radius: int):
    """Rows (bucket, node, fingerprint words, packed seeds, seed of the bucket), sorted by bucket, to edges (a, b)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for table in whole_groups(batches, 1 << 15):
            columns = [c.to_numpy() for c in table.columns]
            cells, node = columns[:2]
            fps = np.stack(columns[2 : 2 + WORDS], axis=1).view(np.uint64)
            seeds = np.stack(columns[2 + WORDS : -1], axis=1).view("<u4")
            bucket = np.cumsum(np.concatenate(([0], (cells[1:] != cells[:-1]).astype(np.int64))))
            row, leaf = leaves(bucket, seeds, columns[-1])
            root = spanning(len(node), ((row[a], row[b]) for a, b in Forest(fps[row], leaf).joining(radius)))
            tied = root != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[root[tied]])], names=["a", "b"])

    return rows


def similar_pairs(sets: list[np.ndarray], similarity: float, seeds: np.ndarray | None = None) -> np.ndarray:
    """The smallest member that each set reaches over pairs with a Jaccard similarity of at least similarity.

    seeds: a row for each set; if given, only sets that share one are compared.
    A set is marked in the group's vocabulary and counted out against those that it isn't tied to
    yet; the sets whose shingles are the most common in the group come first, as they tie the most.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    if not sizes.any():
        return np.arange(n)
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = ids.astype(np.int32)
    starts, filled = np.cumsum(sizes) - sizes, sizes > 0
    common = np.zeros(n)
    common[filled] = np.add.reduceat(np.bincount(ids)[ids], starts[filled]) / sizes[filled]
    order = np.argsort(-common, kind="stable")
    mark = np.zeros(len(vocabulary), dtype=np.uint8)
    root = np.arange(n)
    place = np.cumsum(filled) - 1
    for step, i in enumerate(order.tolist()):
        later = order[step + 1 :]
        open_ = later[(root[later] != root[i]) & filled[later]]
        open_ = open_[np.minimum(sizes[open_], sizes[i]) + 1e-9 >= similarity * np.maximum(sizes[open_], sizes[i])]
        if seeds is not None:
            open_ = open_[(seeds[open_] == seeds[i]).any(axis=1)]
        if not len(open_) or not sizes[i]:
            continue
        mine = ids[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        if 2 * len(open_) > n:
            both = np.add.reduceat(mark[ids], starts[filled], dtype=np.int64)[place[open_]]
        else:
            length = sizes[open_]
            begin = np.cumsum(length) - length
            at = np.arange(int(length.sum())) + np.repeat(starts[open_] - begin, length)
            both = np.add.reduceat(mark[ids[at]], begin, dtype=np.int64)
        mark[mine] = 0
        near = open_[both + 1e-9 >= similarity * (sizes[i] + sizes[open_] - both)]
        if len(near):
            joined = np.isin(root, np.append(root[near], root[i]))
            root[joined] = root[joined].min()
    return root


def _exact(similarity: float):
    """Rows (bucket, node, shingles, packed seeds), sorted by bucket, to edges (a, b). What shares no seed is not compared, in buckets of any size."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1 << 10):
            bucket, node = table.column(0).to_numpy(), table.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            shingles = table.column(2)
            seeds = np.stack([table.column(k).to_numpy() for k in range(3, table.num_columns)], axis=1).view("<u4")
            a, b = [], []
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if high - low > 1:
                    mine = node[low:high]
                    root = similar_pairs([np.frombuffer(x.as_py(), dtype="<u8") for x in shingles.slice(low, high - low)], similarity, seeds[low:high])
                    tied = root != np.arange(high - low)
                    a.append(mine[tied])
                    b.append(mine[root[tied]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            table = shingles = seeds = None
        give_back()

    return rows


def _differs(common: int, own: int, other: int) -> float:
    """Probability that a bit of the fingerprints differs, of sets with so many shingles in common and to themselves."""
    odds = [np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n for n in (common, own, other)]
    # by the votes in common, whether each set's own votes make it a majority
    first, second = (np.array([odds[k][max(0, (common + n) // 2 + 1 - votes) :].sum() for votes in range(common + 1)]) for k, n in ((1, own), (2, other)))
    return float(odds[0] @ (first * (1 - second) + second * (1 - first)))


def candidate_radius(similarity: float) -> int:
    """Bits in which the fingerprints of two sets so similar differ at most: the expected ones and DEVIATIONS deviations.

    A bit of large sets differs with the share of the angle between them. In small ones it does more
    often, the most in about the smallest that can be so similar without being equal.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    if 0 < similarity < 1:
        least = math.ceil(1 / (1 - similarity) - 1e-9)
        for union in range(least, 3 * least + 1):
            for common in range(math.ceil(similarity * union - 1e-9), union):
                share = max(share, *[_differs(common, own, union - common - own) for own in range((union - common) // 2 + 1)])
    return math.ceil(64 * WORDS * (share + DEVIATIONS * math.sqrt(share * (1 - share) / (64 * WORDS))))


def similar_links(table: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that join all whose sets are similar, each set by the least row that has it. table: sketches(), written, with a column row."""
    words, seeds = [f"f{k}" for k in range(WORDS)], [f"s{k}" for k in range(SEEDS)]
    nodes = written(table.groupBy("set_hash").agg(F.min("row").alias("node"), F.first("size").alias("size"), *[F.first(c).alias(c) for c in words + seeds]).drop("set_hash"), "shingle-sets")
    total = nodes.count()
    packs = [f"p{k}" for k in range(0, SEEDS, 2)]
    packed = [F.shiftleft(seeds[k + 1], 32).bitwiseOR(F.col(seeds[k]).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"p{k}") for k in range(0, SEEDS, 2)]
    dealt = nodes.select(F.posexplode(F.array(*[F.xxhash64(F.lit(k), s) for k, s in enumerate(seeds)])).alias("last", "cell"), "node", *words, *packed)
    columns = ["cell", "node", *words, *packs, F.col("last").cast("long")]
    links = bucket_links(dealt.select(*columns), _near(candidate_radius(similarity)), total * SEEDS, BUCKET_LIMIT)
    parts = connected_components(written(links, "candidate-links"), "candidates")
    held = written(nodes.join(parts, "node").select("node", "size", "component", *seeds, *packed), "candidate-nodes")
    sizes = written(held.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")), "candidate-groups")
    big = sizes.where((F.col("n") > GROUP_DOCS) | (F.col("shingles") > GROUP_SHINGLES)).select("component", F.col("n").alias("members"))
    if big.isEmpty():
        keyed = held.select(F.col("component").alias("bucket"), "node", *packs)
    else:
        # in a large group, documents that share a seed are compared
        marked = join_groups(held, big, "component", "members", total)
        few = marked.where("members IS NULL").select(F.col("component").alias("bucket"), "node", *packs)
        many = marked.where("members IS NOT NULL").select(F.explode(F.array(*[F.xxhash64("component", F.lit(k), s) for k, s in enumerate(seeds)])).alias("cell"), "node", "size", *packs)
        counts = many.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
        shards = F.ceil(2 * F.greatest(F.col("n") / GROUP_DOCS, F.col("shingles") / GROUP_SHINGLES)).cast("int")
        large = written(counts.where((F.col("n") > GROUP_DOCS) | (F.col("shingles") > GROUP_SHINGLES)).select("cell", "n", shards.alias("shards")), "large-groups")
        keyed = few.unionByName(deal(many.drop("size"), large, total * SEEDS))
    keyed = written(keyed, "candidate-buckets")
    # only the sets of candidates, and a few more, are shuffled
    test = maybe_repeated(table.sparkSession, *repeated_cells(keyed.select(F.xxhash64("node").alias("h")), "h", keyed.count(), 1))
    sets = table.select(F.col("row").alias("node"), "shingles").where(test(F.xxhash64("row"))).join(keyed.hint("merge"), "node").select("bucket", "node", "shingles", *packs)
    return sets.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_exact(similarity), "a long, b long").distinct()


def similar_classes(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, component_id.

    Documents link where their sets of shingles (words as in near_duplicates(), fewer words than a
    shingle: the whole text) have a Jaccard similarity of at least similarity; component_id is the
    smallest id that links reach, null where no document of the class has one. Documents without
    words are alike. A link is missed where two documents share too few seeds (none; where a bucket is
    large, one or two of twelve) or their fingerprints lie beyond five deviations of the most that
    sets of any size differ: at the similarity itself in about one of 100,000, fewer above it.
    Null and empty texts are alike; rows that repeat an id or a text each give a row; texts are read
    whole, however long; an empty table gives no rows; other columns are ignored.
    """
    table = written(sketches(docs, shingle, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    parts = connected_components(written(similar_links(table, similarity), "similar-links"), "similar")
    groups = written(table.groupBy("set_hash").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "set-rows")
    classes = written(groups.join(parts, "node", "left").select("set_hash", "first_id", "n", F.coalesce("component", "node").alias("component")), "set-classes")
    least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    named = join_groups(classes, written(least, "set-ids"), "component", "members", groups.count(), "inner")
    answers = written(named.select("set_hash", "component_id", "n"), "set-answers")
    return join_groups(table.select("doc_id", "text_hash", "set_hash"), answers, "set_hash", "n", table.count(), "inner").select("doc_id", "text_hash", "component_id")


def drop_similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, the one whose id names it; all columns stay.

    Rows that repeat that id and text all stay, as do rows without an id.
    """
    found = similar_classes(docs, similarity, shingle, id_col, text_col)
    dropped = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "near-copies")
    test = maybe_repeated(docs.sparkSession, *repeated_cells(dropped.select(F.xxhash64("__id", "__hash").alias("h")), "h", dropped.count(), 1))
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__hash"))
    # rows that are surely no copies pass straight through
    marked = rows.withColumn("__maybe", test(F.xxhash64("__id", "__hash")))
    kept = marked.where("__maybe").join(dropped, ["__id", "__hash"], "left_anti").select("__row")
    return marked.where("NOT __maybe").select("__row").unionByName(kept).select("__row.*")
