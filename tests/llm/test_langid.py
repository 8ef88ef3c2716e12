import random
import zlib

import numpy as np
import pytest

from dyadspark.llm.langid import UNKNOWN, WIDTHS, WINDOW, Network, Reader, keep_identified, op10_langid, predict_languages, train, train_on
from tests.llm.helpers import awkward_docs, save

SYLLABLES = {"xa": "ba ko mi tu ra lo".split(), "yb": "schr ung ein ich tz".split(), "zc": "éa oui ère çon ê".split()}


def text_in(lang, seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=300):
    return [(k, text_in(lang := sorted(SYLLABLES)[k % 3], k, 3 + k % 60), lang, "s", 1) for k in range(n)]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(spark, tmp_path):
    docs = corpus()
    rows = {r["doc_id"]: r for r in op10_langid(spark, save(tmp_path, documents=docs)).collect()}
    assert len(rows) == len(docs) and all(rows[d[0]]["held_out"] == is_held_out(d[0]) for d in docs)
    held = [d for d in docs if is_held_out(d[0])]
    assert held and sum(rows[d[0]]["lang_pred"] == d[2] for d in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_predictions_use_text_alone(spark, tmp_path):
    docs = corpus(200)
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    one = op10_langid(spark, save(tmp_path / "a", documents=docs)).collect()
    # labels and sources of held-out documents change nothing
    other = op10_langid(spark, save(tmp_path / "b", documents=[(i, t, None if is_held_out(i) else lang, "other", n) for i, t, lang, s, n in docs])).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_awkward_rows(spark, tmp_path):
    docs = awkward_docs()
    got = op10_langid(spark, save(tmp_path, documents=docs)).collect()
    assert len(got) == len(docs)
    for text, found in ((None, {UNKNOWN}), ("", {UNKNOWN}), ("123 456 --- !!!", {UNKNOWN})):
        ids = [d[0] for d in docs if d[1] == text and d[0] is not None]
        assert {r["lang_pred"] for r in got if r["doc_id"] in ids} == found
    assert all(r["lang_pred"] in {"en", "fr", "de", "ja", UNKNOWN} for r in got)
    assert next(r for r in got if r["doc_id"] == 19)["lang_pred"] != UNKNOWN


def test_nothing_to_learn_from(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in predict_languages(docs).collect()} == {UNKNOWN}
    assert op10_langid(spark, save(tmp_path, documents=[])).collect() == []


def test_rejected_documents_go_and_columns_stay(spark):
    rows = [(i, t, lang, "x", "y", "z") for i, t, lang, *_ in corpus(150)] + [(900, "12 34", None, "x", "y", "z"), (901, None, None, "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score string, draw string")
    out = keep_identified(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert not kept & {900, 901} and len(kept) >= 145


def plain_scores(net: Network, window: bytes) -> np.ndarray:
    """The network as its layers say, position by position."""
    x = np.frombuffer(window.ljust(WINDOW + max(WIDTHS) - 1, b"\0"), dtype=np.uint8)
    maxima = []
    for f, b, w in zip(net.filters, net.biases, WIDTHS, strict=True):
        z = [sum(net.embedding[x[i + j]] @ f[j] for j in range(w)) + b for i in range(WINDOW)]
        maxima.append(np.max(z, axis=0))
    s = np.maximum(np.concatenate(maxima), 0) @ net.weights + net.offsets
    p = np.exp(s - s.max())
    return p / p.sum()


def test_tables_give_what_the_layers_give():
    windows = [text_in(lang, 3).encode()[:WINDOW] for lang in SYLLABLES]
    net = train(windows * 4, list(SYLLABLES) * 4, epochs=2)
    flat = np.stack([np.frombuffer(w.ljust(WINDOW, b"\0"), dtype=np.uint8) for w in windows])
    got = np.exp(Reader(net).log_odds(flat))
    assert np.allclose(got, [plain_scores(net, w) for w in windows], atol=1e-4)


def test_query_gives_what_the_layers_give(spark, tmp_path):
    """Every row of the query, repeated ones and very long texts too, by the plain layers over all windows."""
    docs = [*corpus(80), (5, text_in("xa", 5), "xa", "s", 1), (5, text_in("xa", 5), "xa", "s", 1), (500, text_in("zc", 9, 3000), "zc", "s", 1), *awkward_docs()[:9]]
    folder = save(tmp_path, documents=docs)
    net = train_on(spark.read.parquet(f"{folder}/documents.parquet"))

    def plain(text):
        data = (text or "").encode()
        if not any(map(str.isalpha, text or "")):
            return UNKNOWN, 0.0
        windows = [data[k : k + WINDOW] for k in range(0, len(data), WINDOW)]
        mean = sum(len(w) * np.log(plain_scores(net, w)) for w in windows) / len(data)
        p = np.exp(mean - mean.max())
        p /= p.sum()
        return net.languages[int(p.argmax())], float(p.max())

    want = sorted(((i, *plain(t)) for i, t, *_ in docs), key=repr)
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in op10_langid(spark, folder).collect()), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-3)


def test_every_language_is_learned(spark, monkeypatch):
    from dyadspark.llm import langid

    monkeypatch.setattr(langid, "TRAINING_DOCS", 300)
    seen = []
    monkeypatch.setattr(langid, "train", lambda windows, labels: seen.append(set(labels)))
    train_on(spark.createDataFrame([(k, f"text {k} of some length", f"l{k % 250}") for k in range(2000)], "doc_id long, text string, lang string"))
    assert len(seen[0]) > 150


def test_the_sample_is_bounded(spark, monkeypatch):
    from dyadspark.llm import langid

    seen = []
    monkeypatch.setattr(langid, "DOCS_PER_LANGUAGE", 20)
    monkeypatch.setattr(langid, "train", lambda windows, labels: seen.append(len(windows)))
    train_on(spark.createDataFrame(corpus(900), "doc_id long, text string, lang string, source string, n long"))
    assert seen and seen[0] <= 2 * 20 * 3 * langid.WINDOWS_PER_DOC


@pytest.mark.parametrize("length", [1, WINDOW - 1, WINDOW, WINDOW + 1, 5 * WINDOW + 3])
def test_documents_of_any_length(length):
    net = train([b"abc", b"xyz"], ["a", "x"], epochs=1)
    best, p = Reader(net).documents([b"a" * length, b"q"])
    assert len(best) == 2 and np.all((p > 0) & (p <= 1))
