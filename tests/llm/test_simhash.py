import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dyadspark.llm import simhash
from dyadspark.llm.components import connected_components
from dyadspark.llm.simhash import Forest, block_keys, fingerprint, fingerprint_links, near_duplicates, op5_simhash, spanning
from tests.llm.helpers import SMALL, ascii_lower, awkward_docs, classes, save, words


def naive(text, k=4):
    found = words(ascii_lower(text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + k]) for i in range(len(found) - k + 1)] or [" ".join(found)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def close(fps, radius=4):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= radius]


def expected(docs, radius=4):
    fps = {naive(t) for _, t, *_ in docs}
    part = classes(sorted(fps), close(sorted(fps), radius))
    first = {}
    for i, t, *_ in docs:
        c = part[naive(t)]
        if i is not None:
            first[c] = min(first.get(c, i), i)
    return sorted((repr(i), f"{naive(t):016x}", first.get(part[naive(t)])) for i, t, *_ in docs)


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for _, text, *_ in awkward_docs():
        if len(text or "") < 5000:
            assert fingerprint((text or "").encode()) == naive(text)


def test_query_on_awkward_rows(spark, tmp_path):
    docs = [d for d in awkward_docs() if len(d[1] or "") < 20_000]
    got = op5_simhash(spark, save(tmp_path, documents=docs)).collect()
    assert sorted((repr(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == expected(docs)


def test_query_on_the_small_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = op5_simhash(spark, SMALL).collect()
    assert sorted((repr(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == expected(docs)


def chains(seed, n):
    """Fingerprints in clusters and chains of few flipped bits, among random ones."""
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 63, n // 3)]
    while len(out) < n:
        x = out[int(rng.integers(len(out)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 7))):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize(("seed", "limit", "mean"), [(1, 20_000, 512), (2, 6, 512), (3, 20_000, 0)])
def test_links_join_what_brute_force_joins(spark, monkeypatch, seed, limit, mean):
    """Also with buckets that are cut into shards, and with the most and narrowest buckets."""
    monkeypatch.setattr(simhash, "BUCKET_MEAN", mean)
    fps = chains(seed, 240)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, limit).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 64 for r in links)
    got = classes(sorted(signed), [(r["a"], r["b"]) for r in links])
    want = classes(fps, close(fps))
    name = dict(zip(fps, signed, strict=True))
    assert {frozenset(k for k in signed if got[k] == c) for c in set(got.values())} == {frozenset(name[k] for k in fps if want[k] == c) for c in set(want.values())}


def test_forest_finds_all_pairs_of_its_buckets():
    rng = np.random.default_rng(0)
    fps = np.array(chains(4, 300), dtype=np.uint64)
    bucket = np.sort(rng.integers(0, 4, len(fps)))
    got = {(int(a), int(b)) for x, y in Forest(fps, bucket).links(5) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(i) if bucket[i] == bucket[j] and int(fps[i] ^ fps[j]).bit_count() <= 5}
    assert {(max(p), min(p)) for p in got} == want and len(got) == len(want)
    wide = np.stack([fps, fps[::-1]], axis=1)
    got = {(max(int(a), int(b)), min(int(a), int(b))) for x, y in Forest(wide, bucket).links(30) for a, b in zip(x, y, strict=True)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i) if bucket[i] == bucket[j] and sum(int(v).bit_count() for v in wide[i] ^ wide[j]) <= 30}


def test_joining_joins_what_all_links_join():
    fps = np.array(chains(6, 400), dtype=np.uint64)
    for parts in (1, 7):
        bucket = np.sort(np.arange(len(fps)) % parts)
        forest = Forest(fps, bucket)
        for radius in (0, 3, 8, 28):
            assert spanning(len(fps), forest.joining(radius)).tolist() == spanning(len(fps), forest.links(radius)).tolist()
    wide = np.random.default_rng(3).integers(0, 1 << 63, (300, 4)).astype(np.uint64)
    wide[150:] = wide[:150]
    wide[150:, 0] ^= np.uint64(0xFFFF)
    forest = Forest(wide, np.zeros(300, dtype=np.int64))
    assert spanning(300, forest.joining(61)).tolist() == spanning(300, forest.links(61)).tolist() == [*range(150), *range(150)]
    dense = np.uint64(1) << np.arange(60, dtype=np.uint64)
    assert sum(len(a) for a, _ in Forest(dense, np.zeros(60, dtype=np.int64)).joining(2)) == 60
    assert list(Forest(dense[:0], np.zeros(0, dtype=np.int64)).joining(2)) == []


def test_spanning_and_components(spark):
    pairs = [(5, 4), (4, 3), (9, 8), (1, 0), (3, 9)]
    root = spanning(10, iter([(np.array([a]), np.array([b])) for a, b in pairs]))
    assert root.tolist() == [0, 0, 2, 3, 3, 3, 6, 7, 3, 3]
    chain = [(k, k + 1) for k in range(300)] + [(1000, 2000), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 2000: 1000}


def test_keys_grow_in_number_with_the_rows():
    counts = [len(block_keys(F.lit(1), 4, rows)) for rows in (10, 10**6, 10**8, 10**12)]
    assert counts == sorted(counts) and counts[0] == 5 and counts[-1] > 30


def test_clashing_columns_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e", 7, "x"), (2, "a b c d e", 8, "y")], "doc_id long, text string, fp int, n string")
    assert {r["component_id"] for r in near_duplicates(docs).collect()} == {1}
    assert op5_simhash(spark, save(tmp_path, documents=[])).collect() == []
