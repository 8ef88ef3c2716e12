from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from dyadspark.llm.langid import op10_langid
from dyadspark.llm.mixing import OP7_SQL
from dyadspark.llm.tokens import default_tokenizer
from tests.llm.helpers import DOCS, ascii_lower, awkward_docs, save, sql
from tests.llm.test_similar import expected as similar_expected


def brute_exact(rows):
    keep = {}
    for r in rows:
        key = ascii_lower(r[1] or "")
        if key not in keep or (r[0] is not None, r[0] or 0) > (keep[key][0] is not None, keep[key][0] or 0):
            keep[key] = r
    return Counter(keep.values())


def brute_near(rows):
    gone = {i for i, c in similar_expected(rows) if i is not None and i != c}
    return Counter(r for r in rows if r[0] not in gone)


def test_stages_and_run_against_brute_force(spark, tmp_path):
    small = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    docs = [tuple(r[c] for c in DOCS.names) for r in small]
    docs += [(i if i is None else i + 10_000, t, lang, s, n) for i, t, lang, s, n in awkward_docs() if len(t or "") < 20_000]
    folder = save(tmp_path, documents=docs)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "mixing", "packing"]
    df, rows = spark.read.parquet(f"{folder}/documents.parquet"), docs
    languages = {(r["doc_id"], r["lang_pred"] != "und" and r["score"] >= 0.5) for r in op10_langid(spark, folder).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = spark.createDataFrame([tuple(r) for r in stage(spark, df, folder).collect()], df.schema)
        assert df.columns == DOCS.names
        got = Counter(tuple(r) for r in df.collect())
        if name == "language ID":
            assert set(got) <= set(docs) and all((r[0], True) in languages for r in got)
            assert all(r[0] is None or (r[0], True) not in languages or r in got for r in docs)
        elif name == "exact dedup":
            assert got == brute_exact(rows)
        elif name == "near dedup":
            assert got == brute_near(rows) and sum(got.values()) < len(rows)
        else:
            (tmp_path / "mix").mkdir()
            taken = {x[0]: x[3] // x[1] if x[1] else None for x in sql(save(tmp_path / "mix", documents=rows), OP7_SQL)}
            assert all(taken[r[0]] in (None, n) for r, n in got.items()) and all(n in (None, 0) or i in {r[0] for r in got} for i, n in taken.items())
        rows = [tuple(r) for r in df.collect()]
    tokenizer = Tokenizer.from_file(default_tokenizer())
    pieces = corpus_pipeline.run(spark, folder).collect()
    total = Counter()
    for r in pieces:
        total[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    want = Counter()
    for r in rows:
        want[r[0]] += len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1
    assert total == want
    ends = sum(int(np.frombuffer(bytes(r["ids"]), "<u4")[-1] == 2) for r in pieces if r["start"] + r["length"] == r["doc_tokens"])
    assert ends == len(rows)


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, save(tmp_path, documents=[])).collect() == []
