import random

import pytest
from tokenizers import Tokenizer, decoders, models, normalizers, pre_tokenizers

from dyadspark.llm.token_counts import MARK, WordCounter, default_vocabulary, op6_token_counts, token_counts, vocabulary
from tests.llm.helpers import awkward_docs, save, words


@pytest.fixture(scope="module")
def library():
    """The tokenizers library's own unigram model over the same pieces."""
    pieces = vocabulary(default_vocabulary())
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always")
    tokenizer.decoder = decoders.Metaspace()
    return tokenizer


def count(library, text):
    found = words(text)
    return len(library.encode(" ".join(found), add_special_tokens=False).ids) if found else 0


def test_query_against_the_library(spark, tmp_path, library):
    docs = awkward_docs()
    got = op6_token_counts(spark, save(tmp_path, documents=docs)).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in got) == sorted((repr(d[0]), len(words(d[1])), count(library, d[1])) for d in docs)


def test_words_against_the_library(library):
    rng = random.Random(1)
    counter = WordCounter(vocabulary(default_vocabulary()), limit=40)
    alphabet = list("aaeehinorst") + ["the", "ing", "é", "ß", "日", "😀", "▁", "<unk>", "</s>", ".", "12", "\x00", "́"]
    for _ in range(4000):
        text = " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 4)))
        assert counter.tokens([w.encode() for w in words(text)]) == count(library, text), repr(text)


def best_splits(word, scores, unknown):
    """Best score over all ways to split, and the counts of those that reach it."""
    if not word:
        return 0.0, {0}
    found = {}
    for k in range(1, len(word) + 1):
        piece = word[:k]
        if piece in scores:
            value, n = scores[piece], 1
        elif k == 1:
            value, n = unknown, len(piece.encode())
        else:
            continue
        rest, counts = best_splits(word[k:], scores, unknown)
        found.setdefault(round(value + rest, 9), set()).update(c + n for c in counts)
    top = max(found)
    return top, found[top]


def test_viterbi_against_all_splits():
    pieces = [("a", -1.0), ("b", -1.5), ("ab", -2.5), ("aba", -2.0), ("bab", -3.25), ("é", -4.0)]
    counter = WordCounter(pieces)
    rng = random.Random(3)
    for _ in range(500):
        word = "".join(rng.choice("aabbéz") for _ in range(rng.randrange(1, 9)))
        score, n = counter.viterbi(word)
        best, counts = best_splits(word, dict(pieces), -14.0)
        assert abs(score - best) < 1e-9 and n in counts


def test_of_equal_scores_the_piece_that_starts_first_wins():
    assert WordCounter([("a", -1.0), ("b", -1.0), ("ab", -2.0)]).viterbi("ab")[1] == 1


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert op6_token_counts(spark, save(tmp_path, documents=[])).collect() == []
    docs = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, n_tokens int")
    assert token_counts(docs).collect()[0]["n_words"] == 2
