import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from dyadspark.llm import repair
from dyadspark.llm.repair import Shard, op1_token_shards, pack, read_token_shards, write_token_shards
from dyadspark.llm.tokens import WordEncoder, default_tokenizer
from tests.llm.helpers import SMALL, awkward_docs, save


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_cache_is_exact(tokenizer):
    rng = random.Random(5)
    alphabet = list("abcdeXYZéÉßİıçñ .,'-!?\n\t\r0123456789«»  ́　日本가ﬁ𝔘😀") + ["<|endoftext|>", "don't", "I'LL ", "\x00", "\x85", "ẞ", "Σ", "ς", "***", "|", "_%", "word", "!!"]
    encode = WordEncoder(default_tokenizer(), limit=50)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert np.frombuffer(encode.ids(text), "<u4").tolist() == ids_of(tokenizer, text), repr(text)


@pytest.mark.parametrize("base", [50, 49_408, 65_535, 70_000])
def test_grammar_round_trip_and_random_access(base):
    rng = np.random.default_rng(base)
    motif = rng.integers(0, base, 40)
    docs = [rng.integers(0, min(base, 9), n).astype("<u4").tobytes() if n % 2 else np.tile(motif, n).astype("<u4").tobytes() for n in (0, 1, 2, 3, 17, 400, 5000, 0)]
    blob, info = pack([1, None, 3, 4, 5, 6, 7, 8], docs, base)
    shard = Shard(blob)
    assert [shard.document(k) for k in range(len(docs))] == docs
    assert shard.doc_ids == [1, None, 3, 4, 5, 6, 7, 8] and info["n_symbols"] < info["n_tokens"]
    for _ in range(200):
        k = int(rng.integers(len(docs)))
        whole = np.frombuffer(docs[k], "<u4")
        start, length = int(rng.integers(0, len(whole) + 3)), int(rng.integers(0, 60))
        assert shard.span(k, start, length).tolist() == whole[start : start + length].tolist()


def test_stored_lengths_are_what_rules_expand_to():
    blob, _ = pack([0], [np.tile([1, 2, 3, 4], 500).astype("<u4").tobytes()], 10)
    shard = Shard(blob)
    assert [len(x) // 4 for x in shard._expansions()[shard.base :]] == shard.lengths.tolist() != []


def test_query_against_the_tokenizer(spark, tmp_path, tokenizer, monkeypatch):
    docs = awkward_docs()
    got = sorted(op1_token_shards(spark, save(tmp_path, documents=docs)).collect(), key=lambda r: r["start"])
    assert len(got) == len(docs)
    at, left = 0, [(d[0], ids_of(tokenizer, d[1]) + [1]) for d in docs]
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        match = next(x for x in left if x[0] == r["doc_id"] and zlib.crc32(np.array(x[1], "<u4").tobytes()) == r["ids_crc32"] and len(x[1]) == r["n_tokens"])
        left.remove(match)
    assert not left
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_many_shards_in_order(spark, tmp_path, tokenizer):
    path = str(tmp_path / "shards")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    write_token_shards(docs.repartition(5), path, shard_tokens=3000)
    got = read_token_shards(spark, path, with_ids=True).orderBy("doc_id").collect()
    at = 0
    for r, d in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        want = np.array(ids_of(tokenizer, d["text"]) + [1], "<u4").tobytes()
        assert (r["doc_id"], r["start"], bytes(r["ids"]), r["ids_crc32"]) == (d["doc_id"], at, want, zlib.crc32(want))
        at += len(want) // 4
    assert spark.read.parquet(path).count() > 20


def test_empty_table(spark, tmp_path):
    assert op1_token_shards(spark, save(tmp_path, documents=[])).collect() == []
    with pytest.raises(ValueError):
        Shard(repair.np.zeros(7, dtype="<u8").tobytes())
