import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dyadspark.llm.packing import Packer, fullest, op4_packing, pack_documents
from dyadspark.llm.tokens import default_tokenizer
from tests.llm.helpers import SMALL, awkward_docs, save


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 30))
def test_fullest_against_all_choices(counts, capacity):
    total, used = fullest(sorted(counts), counts, capacity)
    assert total == sum(n * k for n, k in used.items()) and all(k <= counts[n] for n, k in used.items())
    assert total == max(s for choice in product(*[range(k + 1) for k in counts.values()]) if (s := sum(n * c for n, c in zip(counts, choice, strict=True))) <= capacity)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(0, 200))
def test_pieces_cover_every_document_without_gaps(sizes, buffer):
    packer, out = Packer(16, buffer_tokens=buffer, reserve=2), []
    texts = [np.arange(n, dtype="<u4").tobytes() for n in sizes]
    for k, ids in enumerate(texts):
        out += packer.add(k, ids)
    check(out + list(packer.close()), dict(enumerate(texts)), 16)


def check(out, texts, capacity):
    parts, sequences = defaultdict(list), defaultdict(list)
    for sequence, offset, (doc, start, ids, tokens) in out:
        parts[doc].append((start, ids))
        sequences[sequence].append((offset, len(ids) // 4))
        assert tokens == len(texts[doc]) // 4
    for doc, ids in texts.items():
        at, whole = 0, b""
        for start, piece in sorted(parts[doc]):
            assert start == at
            at, whole = at + len(piece) // 4, whole + piece
        assert whole == ids
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity and at & (at - 1) == 0


def brute(rows, docs, capacity=4096):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    texts = defaultdict(list)
    for d in docs:
        texts[d[0]].append(np.array(tokenizer.encode(d[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at and n > 0
            at += n
        assert at <= capacity and at & (at - 1) == 0
    assert sum(r["length"] for r in rows) == sum(len(x) // 4 for v in texts.values() for x in v)
    for doc, mine in pieces.items():
        if len(texts[doc]) == 1:
            at, ids = 0, texts[doc][0]
            for r in sorted(mine, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
                assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
                at += r["length"]
            assert 4 * at == len(ids)
    assert set(pieces) == set(texts)


def test_query_on_awkward_rows(spark, tmp_path):
    docs = awkward_docs()
    brute(op4_packing(spark, save(tmp_path, documents=docs)).collect(), docs)


def test_query_on_the_small_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    brute(op4_packing(spark, SMALL).collect(), docs)


def test_ids_empty_table_and_capacity(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here", "x")], "doc_id long, text string, start string")
    row = pack_documents(docs, capacity=2, with_ids=True).collect()[0]
    assert zlib.crc32(bytes(row["ids"])) == row["ids_crc32"]
    assert op4_packing(spark, save(tmp_path, documents=[])).collect() == []
    with pytest.raises(ValueError):
        pack_documents(docs, capacity=1000)
