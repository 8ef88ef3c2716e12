import math
import random
from collections import defaultdict

import numpy as np
import pytest

from dyadspark.llm import similar
from dyadspark.llm.similar import drop_similar, similar_classes, similar_pairs
from tests.llm.helpers import SMALL, ascii_lower, awkward_docs, classes, sentence, words


def shingles(text, k=5):
    found = words(ascii_lower(text or ""))
    return frozenset([" ".join(found[i : i + k]) for i in range(len(found) - k + 1)] or [" ".join(found)] * bool(found))


def alike(a, b):
    both = len(a & b)
    return a == b or 5 * both >= 4 * (len(a) + len(b) - both)


def expected(docs):
    sets = defaultdict(list)
    for i, t, *_ in docs:
        sets[shingles(t)].append(i)
    keys = list(sets)
    part = classes(list(range(len(keys))), [(i, j) for i in range(len(keys)) for j in range(i) if keys[i] and keys[j] and alike(keys[i], keys[j])])
    out = []
    for k, key in enumerate(keys):
        members = [i for x, other in enumerate(keys) if part[x] == part[k] for i in sets[other] if i is not None]
        out += [(i, min(members, default=None)) for i in sets[key]]
    return sorted(out, key=repr)


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"new{rng.randrange(1000)}" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("limit", [2000, 3])
def test_classes_against_brute_force(spark, monkeypatch, limit):
    """Also with groups so large that they are cut up."""
    monkeypatch.setattr(similar, "GROUP_DOCS", limit)
    texts = [f"{sentence(s, 200)} tail{s}" for s in range(4)]
    docs = [d for d in awkward_docs() if len(d[1] or "") < 20_000] + [(100 + k, edited(texts[k % 4], k, 0.03 * (k % 3)), "en", "a", 1) for k in range(48)]
    got = [(r["doc_id"], r["component_id"]) for r in similar_classes(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")).collect()]
    assert sorted(got, key=repr) == expected(docs)


def test_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = [(r["doc_id"], r["component_id"]) for r in similar_classes(docs).collect()]
    assert sorted(got, key=repr) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_similar_pairs_against_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = [np.unique(rng.integers(0, 60, int(rng.integers(0, 30)))).astype("<u4") for _ in range(4)]
        sets = [np.unique(np.concatenate((b, rng.integers(0, 200, int(rng.integers(0, 3))).astype("<u4")))) for b in base for _ in range(4)]
        plain = [frozenset(s.tolist()) for s in sets]
        want = classes(list(range(len(sets))), [(i, j) for i in range(len(sets)) for j in range(i) if plain[i] and plain[j] and 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])])
        assert similar_pairs(sets, 0.8).tolist() == [want[i] for i in range(len(sets))]


def test_one_document_of_each_class_stays(spark):
    rows = [(i, t, k, "c", "d", "e") for k, (i, t, *_) in enumerate(awkward_docs()) if len(t or "") < 20_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, row string, component_id string, size string")
    out = drop_similar(docs)
    assert out.columns == docs.columns
    want = dict.fromkeys(rows)
    for i, c in expected(rows):
        for r in list(want):
            if r[0] == i and i is not None and i != c:
                del want[r]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_short_texts_meet_texts_of_one_word_more(spark):
    """Four shingles of five in common: bits differ more often than by the angle of large sets."""
    texts = [[" ".join(f"p{k}w{w}" for w in range(n)) for n in (8, 9)] for k in range(500)]
    docs = spark.createDataFrame([(2 * k + j, t) for k, pair in enumerate(texts) for j, t in enumerate(pair)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar_classes(docs).collect()}
    assert got == {i: i - i % 2 for i in range(1000)}


def test_links_in_large_buckets(spark):
    """Thousands of documents share a passage, and with it seeds; hundreds of near copies among them are found, and nothing else is tied."""
    passage = " ".join(f"common{w}" for w in range(60))
    docs = [(k, f"{passage} " + " ".join(f"own{k}w{w}" for w in range(45))) for k in range(6000)]
    # 101 shingles of which 90 stay: a similarity of 90 in 112
    copies = [(10_000 + k, " ".join(f"new{k}w{w}" if 94 <= w < 95 or 100 <= w < 101 else x for w, x in enumerate(docs[k][1].split()))) for k in range(0, 6000, 10)]
    assert 0.8 <= min(len(shingles(docs[k - 10_000][1]) & shingles(t)) / len(shingles(docs[k - 10_000][1]) | shingles(t)) for k, t in copies[:20]) < 0.83
    got = {r["doc_id"]: r["component_id"] for r in similar_classes(spark.createDataFrame(docs + copies, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i if i < 10_000 else i - 10_000 for i, _ in docs + copies}


def test_the_radius_holds_for_sets_of_all_sizes():
    for union in (5, 6, 10, 15, 25, 40):
        for own in range(union // 5 + 1):
            p = similar._differs(union - union // 5, own, union // 5 - own)
            radius = similar.candidate_radius(0.8)
            assert sum(math.comb(256, d) * p**d * (1 - p) ** (256 - d) for d in range(radius + 1, 257)) < 1e-4


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, other int")
    assert drop_similar(docs).collect() == [] and similar_classes(docs).collect() == []


def test_leaves_hold_rows_that_share_seeds(monkeypatch):
    """Small buckets stay; in large ones, rows with three seeds in common meet, and copies stay together."""
    monkeypatch.setattr(similar, "LEAF", 10)
    rng = np.random.default_rng(1)
    bucket, seeds, last = [], [], []
    for b, n in enumerate((1, 2, 9, 60, 200, 40)):
        for _ in range(n):
            bucket.append(b)
            last.append(b % 3)
            seeds.append([7] * 8 if b == 5 else rng.integers(0, 3 if n < 100 else 6, 8).tolist())
    bucket, seeds, last = np.array(bucket), np.array(seeds, dtype="<u4"), np.array(last)
    row, leaf = similar.leaves(bucket, seeds, last)
    assert np.all(np.diff(leaf) >= 0) and np.bincount(leaf)[leaf].min() > 1
    met = {(int(a), int(b)) for x in np.unique(leaf) for a in row[leaf == x] for b in row[leaf == x] if a < b}
    assert all(bucket[a] == bucket[b] for a, b in met)
    for a in range(len(bucket)):
        for b in range(a + 1, len(bucket)):
            later = (seeds[a] == seeds[b])[last[a] + 1 :].sum()
            if bucket[a] == bucket[b] and (bucket[a] in (1, 2, 5) or later >= 2):
                assert (a, b) in met
    assert len(met) < sum(n * n for n in (2, 9, 60, 200, 40)) / 3
