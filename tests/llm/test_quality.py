import math
from collections import Counter

import pyarrow as pa
import pytest

from dyadspark.llm.quality import OP9_SQL, PATH, RULES, binomial_tail, cutoffs_at, measures, op9_quality, proven_steps, quality_verdicts
from tests.llm.helpers import SMALL, awkward_docs, rows_of, save, sentence, sql, words


def naive(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


def labels(rows):
    return pa.Table.from_pylist([{"doc_id": i, "quality": q, "toxic": 0} for i, q in rows], schema=pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]))


def test_query_on_awkward_rows(spark, tmp_path):
    docs = awkward_docs() + [(200, (sentence(1, 12) + " ") * 6 + sentence(9, 30), "en", "a", 1), (201, "\n".join(["one line"] * 30), "en", "a", 1)]
    got = op9_quality(spark, save(tmp_path, documents=docs, labels=labels([(13, 1), (13, 1), (None, 1), (14, None), (15, 0)]))).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((repr(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted((repr(d[0]), *naive(d[1])) for d in docs)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])  # so few labels prove no cutoff


def test_sql_twin(spark):
    assert rows_of(op9_quality(spark, SMALL)) == sql(SMALL, OP9_SQL)


def test_binomial_tail(spark):
    cases = [(10, 0, 0.1), (10, 3, 0.5), (500, 2, 0.01), (500, 6, 0.01), (1, 0, 0.3), (0, 0, 0.2), (4000, 20, 0.01)]
    for n, k, p in cases:
        exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        frame = spark.createDataFrame([(n, k)], "n long, k long")
        got = frame.select(binomial_tail(frame.n, frame.k, p)).first()[0]
        assert got == (1.0 if k > n * p else pytest.approx(exact, rel=1e-9))


def bench(n_good, n_bad, share):
    """Good documents, of which a share has many symbols, and bad ones that have some."""
    plain, odd = sentence(2, 40), sentence(3, 40) + " " + "#" * 50
    rows = [(k, odd if k < share * n_good else plain, "en") for k in range(n_good)]
    return rows + [(n_good + k, " ".join(w + "*" * (i % 2) for i, w in enumerate(plain.split())), "en") for k in range(n_bad)]


@pytest.mark.parametrize(("n", "share", "proven"), [(400, 0.0, True), (400, 0.05, False), (50, 0.0, False)])
def test_cutoffs_need_proof(spark, n, share, proven):
    docs = spark.createDataFrame(bench(n, 50, share), "doc_id long, text string, lang string")
    good = spark.createDataFrame([(k, 1) for k in range(n)], "doc_id long, quality int")
    step = proven_steps(measures(docs), good).first()["proven"]
    assert (cutoffs_at(step).get("symbols") == min(RULES["symbols"][2])) == proven
    rows = {r["doc_id"]: r["kept"] for r in quality_verdicts(docs, good).collect()}
    assert all(rows[k] for k in range(n)) and (not any(rows[k] for k in range(n, n + 50))) == proven


def strata():
    """Eight strata of 200 documents, in each of which one more has many symbols than in the one before, so that walks end at different steps."""
    rows, good = [], []
    for k in range(1600):
        lang, rank = (None, *[f"l{s}" for s in range(7)])[k % 8], k // 8
        amount = 60 if rank == 0 else 30 if rank <= k % 8 else 0
        text = sentence(k % 7 + 1, 40) + "#" * amount + "!" * (90 if 50 < rank <= 50 + k % 8 // 2 else 0)
        rows.append((k, text, lang, "s", len(text)))
        good.append((k, int(rank < 60 or rank % 9 > 0)))
    return rows, good


def walk(rows, good, max_risk, error):
    """The proven step of each stratum by the exact binomial distribution."""
    by = {}
    wanted = {i for i, q in good if q == 1}
    for i, text, lang, *_ in rows:
        n, chars, symbols, dup, rep = naive(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        have = {"symbols": (symbols, n), "shouting": ((text or "").count("!"), n), "same_lines": (dup, len(lines)), "repeats": (rep, n), "long_words": (chars, n)}
        step = next((k for k, (rule, c) in enumerate(PATH, 1) if have[rule][1] and 1000 * have[rule][0] > c * have[rule][1]), None)
        if i in wanted:
            by.setdefault(lang, []).append(step)
    out = {}
    for lang, steps in by.items():
        n, proven = len(steps), 0
        for k in range(1, len(PATH) + 1):
            bad = sum(s is not None and s <= k for s in steps)
            if sum(math.comb(n, j) * max_risk**j * (1 - max_risk) ** (n - j) for j in range(bad + 1)) > error / len(by):
                break
            proven = k
        out[lang] = proven
    return out


def test_cutoffs_are_taken_and_both_tail_and_correction_count(spark, tmp_path):
    rows, good = strata()
    folder = save(tmp_path, documents=rows, labels=labels(good))
    got = rows_of(op9_quality(spark, folder))
    assert got == sql(folder, OP9_SQL)
    found, known = measures(spark.read.parquet(f"{folder}/documents.parquet")), spark.read.parquet(f"{folder}/labels.parquet")
    steps = {r["stratum"]: r["proven"] for r in proven_steps(found, known).collect()}
    assert steps == walk(rows, good, 0.05, 0.05) and len(set(steps.values())) > 1 and sum(s > 2 for s in steps.values()) >= 3
    judged = quality_verdicts(spark.read.parquet(f"{folder}/documents.parquet"), known).where("NOT base_failed")
    rejected = judged.where("NOT kept").count()
    assert 0 < rejected < judged.count() / 10
    # without the correction, or at another risk, other steps are proven
    assert walk(rows, good, 0.05, 8 * 0.05) != steps and walk(rows, good, 0.08, 0.05) != steps
    for twin in (OP9_SQL.replace("0.05 / (SELECT", "0.4 / (SELECT"), OP9_SQL.replace("range(bad + 1)", "range(bad)")):
        assert twin != OP9_SQL and sql(folder, twin) != got


def test_null_strata_clashing_columns_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, sentence(1, 30), None, "x", 1), (2, None, "en", "y", 2)], "doc_id long, text string, lang string, stratum string, words int")
    good = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r["doc_id"]: (r["kept"], r["stratum"]) for r in quality_verdicts(docs, good).collect()} == {1: (True, None), 2: (False, "en")}
    assert op9_quality(spark, save(tmp_path, documents=[], labels=labels([]))).collect() == []
