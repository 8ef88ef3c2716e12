import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dyadspark.llm import exact_dedup
from dyadspark.llm.common import written
from dyadspark.llm.exact_dedup import OP3_SQL, drop_exact_duplicates, exact_duplicates, mark_repeated, op3_exact_dedup
from tests.llm.helpers import DOCS, SMALL, ascii_lower, awkward_docs, rows_of, save, sql


def expected(docs):
    groups = defaultdict(list)
    for d in docs:
        groups[hashlib.sha256(ascii_lower(d[1] or "").encode()).hexdigest()].append(d[0])
    return {h: (max((i for i in ids if i is not None), default=None), len(ids)) for h, ids in groups.items()}


@pytest.mark.parametrize("cells", [14, 30])
def test_awkward_rows_with_and_without_false_alarms(spark, tmp_path, monkeypatch, cells):
    monkeypatch.setattr(exact_dedup, "MAX_CELLS_LOG2", cells)
    docs = awkward_docs() + [(1000 + k, f"text number {k}", "en", "z", 1) for k in range(3000)]
    got = op3_exact_dedup(spark, save(tmp_path, documents=docs)).collect()
    want = expected(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[r["text_sha256"]]
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(want)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("cells", [13, 30])
def test_only_repeats_and_few_others_are_taken_for_repeats(spark, monkeypatch, cells):
    monkeypatch.setattr(exact_dedup, "MAX_CELLS_LOG2", cells)
    table = written(spark.range(6000).select(F.xxhash64(F.when(F.col("id") % 20 == 0, F.col("id") % 200).otherwise(F.col("id"))).alias("h"), F.col("id")).sortWithinPartitions("h"), "t")
    marked = mark_repeated(table, 6000).collect()
    assert len(marked) == 6000 and all(r["maybe"] for r in marked if r["id"] % 20 == 0)
    assert sum(r["maybe"] for r in marked if r["id"] % 20) < 0.03 * 5700


def test_sql_twin(spark):
    assert rows_of(op3_exact_dedup(spark, SMALL)) == sql(SMALL, OP3_SQL)


def test_drop_keeps_clashing_columns_and_one_row_of_each_text(spark):
    names = ["doc_id", "text", "row", "sha", "id", "tie", "maybe", "h", "n"]
    rows = [(i, t, "r", "s", "i", "t", "m", "h", k) for k, (i, t, *_) in enumerate(awkward_docs())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, sha string, id string, tie string, maybe string, h string, n int")
    out = drop_exact_duplicates(docs)
    assert out.columns == names
    assert sorted(hashlib.sha256(ascii_lower(r["text"] or "").encode()).hexdigest() for r in out.collect()) == sorted(expected(rows))
    assert {r["doc_id"] for r in out.collect()} >= {24, 11, 12}


def test_empty_table(spark, tmp_path):
    folder = save(tmp_path, documents=[])
    out = op3_exact_dedup(spark, folder)
    assert out.collect() == [] and out.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    empty = spark.read.parquet(f"{folder}/documents.parquet")
    assert drop_exact_duplicates(empty).collect() == [] and drop_exact_duplicates(empty).columns == DOCS.names
    assert exact_duplicates(empty).count() == 0
