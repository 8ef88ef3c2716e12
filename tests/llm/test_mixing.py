import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from dyadspark.llm import mixing
from dyadspark.llm.mixing import OP7_SQL, apply_mix, mix, newton_tilts, op7_mixing, source_targets
from tests.llm.helpers import SMALL, awkward_docs, rows_of, save, sql, words


def targets_of(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """The budget's shares, divided again and again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, out, left = share * sum(sizes.values()), {}, list(order)
    while left:
        total = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / total > cap * sizes[s]]
        out |= {s: cap * sizes[s] for s in over} if over else {s: rest * weight[s] / total for s in left}
        rest -= sum(cap * sizes[s] for s in over)
        left = [s for s in left if s not in out]
    return out


def tilt_of(items, target, cap=2.0):
    """The multiplier of sizes with priors by halving."""
    low, high = -50.0, math.log(cap / min(p for _, p in items))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(s * min(cap, p * math.exp(min(mid * s, 50))) for s, p in items) < target else (low, mid)
    return (low + high) / 2


def test_targets_share_the_budget_under_their_caps(spark):
    rng = random.Random(3)
    for _ in range(12):
        sizes = {s: rng.choice((0, 1, rng.randrange(1000))) for s in rng.sample(["a", "b", "c", "d", "e", None], rng.randint(1, 6))}
        rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r["source"]: r["target"] for r in rows} == pytest.approx(targets_of(sizes), abs=1e-6)


def check(rows, docs):
    sizes, given_, target, single = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    size = {}
    for d in docs:
        sizes[d[3]] += len(words(d[1]))
        size[d[0]] = len(words(d[1]))
        single[d[3]] = max(single[d[3]], len(words(d[1])))
    want = targets_of(dict(sizes))
    source = {d[0]: d[3] for d in docs if d[0] is not None}
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        if r["doc_id"] is not None:
            s = source[r["doc_id"]]
            assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s]
            assert abs(r["target"] - want[s]) < 1e-6
            given_[s] += r["taken"]
            target[s] = r["target"]
    return {s: (given_[s], target[s], single[s]) for s in target}


def test_query_on_awkward_rows(spark, tmp_path):
    docs = awkward_docs()
    folder = save(tmp_path, documents=docs)
    rows = op7_mixing(spark, folder).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    assert rows_of(op7_mixing(spark, folder)) == sorted((tuple(r[c] for c in sorted(r.asDict())) for r in rows), key=repr)


def test_sources_come_near_their_targets(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    for got, target, largest in check(op7_mixing(spark, SMALL).collect(), docs).values():
        assert abs(target - got) <= largest / 2 + 1e-6


def oracle(docs):
    """doc_id to rate and copies, one source after the other and document by document."""
    sources = defaultdict(list)
    for i, text, source in docs:
        sources[source].append((i, len(words(text)), int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:12], 16)))
    targets = targets_of({s: sum(n for _, n, _ in rows) for s, rows in sources.items()})
    out = {}
    for s, rows in sources.items():
        items = [(n, 1.0) for _, n, _ in rows if n]
        tilt = tilt_of(items, targets[s]) if targets[s] < 2 * sum(n for n, _ in items) else math.log(2)
        rate = {i: min(2.0, math.exp(min(tilt * n, 1))) for i, n, _ in rows}
        copies = {i: math.floor(r) for i, r in rate.items()}
        room = targets[s] - sum(n * copies[i] for i, n, _ in rows)
        wait = sorted((u / (rate[i] - copies[i]), n, i, u) for i, n, u in rows if n and rate[i] > copies[i] and copies[i] < 2)
        while wait and wait[0][1] <= room:
            _, n, i, _ = wait.pop(0)
            copies[i] += 1
            room -= n
        wait.sort(key=lambda x: (-x[1], x[3]))
        left = []
        for _, n, i, _ in wait:
            if n <= room:
                copies[i] += 1
                room -= n
            else:
                left.append((n, i))
        if left and min(left)[0] < 2 * room:
            copies[next(i for n, i in left if n == min(left)[0])] += 1
        out |= {i: (rate[i], copies[i]) for i, _, _ in rows}
    return out


@pytest.mark.parametrize("limit", [50_000, 0])
def test_rates_and_copies_are_those_of_an_oracle(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    rng = random.Random(11)
    docs = [(k, "word " * rng.choice((0, 1, 2, 5, 9, 30, 31, 400)), rng.choice(["a", "b", "c", "d", None])) for k in range(600)] + [(1000, "w " * 20_000, "e")] + [(1001 + k, "w " * 100, "e") for k in range(100)]
    rows = mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    want = oracle(docs)
    for r in rows:
        rate, copies = want[r["doc_id"]]
        assert r["rate"] == pytest.approx(rate, rel=1e-8) and r["copies"] == copies
    given, target, by_size = Counter(), {}, defaultdict(set)
    source = {i: s for i, _, s in docs}
    for r in rows:
        s = source[r["doc_id"]]
        given[s] += r["size"] * r["rate"]
        target[s] = r["target"]
        by_size[s].add((r["size"], r["rate"]))
    for s, t in target.items():
        assert abs(given[s] - t) <= 1e-9 * t
        # one rate for each size, and different ones wherever the cap leaves room
        assert len(by_size[s]) == len(dict(by_size[s])) and (t == 2 * sum(n for n, _ in by_size[s]) or len({r for _, r in by_size[s]}) > 1 or all(r == 2 for n, r in by_size[s] if n))


def test_a_long_text_does_not_keep_short_ones_out(spark):
    docs = [(0, "w " * 20_000, "a")] + [(k, "w " * 100, "a") for k in range(1, 101)]
    rows = mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert rows[0]["target"] == 45_000 and abs(sum(r["taken"] for r in rows) - 45_000) <= 5_000


def test_unsettled_rates_are_refused(spark):
    moments = spark.createDataFrame([("sa", s, 1.0, 3) for s in (1, 10, 1000)], "skey string, size long, prior double, n long")
    sources = spark.createDataFrame([("sa", 9, 400.0)], "skey string, docs long, target double")
    with pytest.raises(RuntimeError):
        newton_tilts(moments, sources, 2.0, steps=1)
    found = newton_tilts(moments, sources, 2.0)[0].first()
    assert found["tilt"] == pytest.approx(tilt_of([(s, 1.0) for s in (1, 10, 1000) for _ in range(3)], 400.0), rel=1e-10)


def test_sql_twin(spark):
    assert rows_of(op7_mixing(spark, SMALL)) == sql(SMALL, OP7_SQL)


def test_rows_are_repeated_as_often_as_the_mix_has_them(spark):
    names = "doc_id long, text string, source string, row string, u int, copies int, tilt string, prior string"
    docs = spark.createDataFrame([(k, "word " * (k % 9), "ab"[k % 2], "r", 1, 2, "t", "p") for k in range(200)], names)
    out = apply_mix(docs)
    assert out.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mix(docs).collect()}
    found = defaultdict(int)
    for r in out.collect():
        found[r["doc_id"]] += 1
    assert {k: n for k, n in copies.items() if n} == dict(found)


def test_prior_rates_tilt_the_mix(spark):
    docs = spark.createDataFrame([(k, "word " * 10, "a", float(k % 2) + 0.5) for k in range(2000)], "doc_id long, text string, source string, prior double")
    rows = mix(docs, share=0.5, prior_col="prior").collect()
    low, high = (sum(r["taken"] for r in rows if r["doc_id"] % 2 == k) for k in (0, 1))
    assert low + high == pytest.approx(10_000, abs=20) and 2.5 < high / low < 3.6 and all(r["rate"] == pytest.approx(0.5 * (0.5 + r["doc_id"] % 2)) for r in rows)


def test_empty_table_and_texts_without_words(spark, tmp_path):
    assert op7_mixing(spark, save(tmp_path, documents=[])).collect() == []
    rows = mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in rows) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
