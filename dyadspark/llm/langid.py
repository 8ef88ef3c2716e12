"""Language identification by a convolutional network over bytes.

A text is cut into windows of fixed length. Filters of several widths run over the embedded bytes
of a window, each keeps its maximum, and a softmax layer reads the maxima. The network is trained in
numpy on the driver, on a bounded sample of labelled windows. To apply it, embedding and filters are
folded into tables by byte pair, so that a position costs two look-ups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.llm.common import drop_held

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
#: The training sample: about so many documents of each language, at most twice that in all, and windows of each;
#: fewer of each where there are so many languages that this would pass TRAINING_DOCS. Every language is learned.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC, TRAINING_DOCS = 400, 4, 80_000
_PAD = max(WIDTHS) - 1
_ASCII_LETTER = re.compile(b"[A-Za-z]")


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x size
    filters: list[np.ndarray]  # width x size x number
    biases: list[np.ndarray]
    weights: np.ndarray  # maxima x languages
    offsets: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What a byte pair adds to every filter that begins with it, and to those of width 3 and 4 that it ends."""
        by_byte = [[self.embedding @ f[j] for j in range(len(f))] for f in self.filters]
        first = np.concatenate([t[0][:, None, :] + t[1][None, :, :] + b for t, b in zip(by_byte, self.biases, strict=True)], axis=2)
        zero = np.zeros((256, 1, 1), dtype=np.float32).transpose(1, 0, 2)
        rest = [t[2][:, None, :] + (t[3][None, :, :] if len(t) > 3 else zero) for t in by_byte if len(t) > 2]
        return first.reshape(65536, -1).astype(np.float32), np.concatenate(rest, axis=2).reshape(65536, -1).astype(np.float32)


class Reader:
    """A trained network, ready to score windows."""

    def __init__(self, net: Network):
        self.net = net
        self.first, self.rest = net.tables()
        self.skip = self.first.shape[1] - self.rest.shape[1]

    def log_odds(self, windows: np.ndarray, block: int = 64) -> np.ndarray:
        """Log-probabilities of the languages. windows: n x WINDOW bytes, padded with zeros."""
        n = len(windows)
        out = np.empty((n, self.first.shape[1]), dtype=np.float32)
        padded = np.zeros((min(block, n), windows.shape[1] + _PAD), dtype=np.int32)
        for low in range(0, n, block):
            some = windows[low : low + block]
            x = padded[: len(some)]
            x[:, : some.shape[1]] = some
            pair = (x[:, :-1] << 8) | x[:, 1:]
            z = self.first[pair[:, :-2]]
            z[:, :, self.skip :] += self.rest[pair[:, 2:]]
            z.max(axis=1, out=out[low : low + len(some)])
        y = np.maximum(out, 0) @ self.net.weights + self.net.offsets
        y -= y.max(axis=1, keepdims=True)
        return y - np.log(np.exp(y).sum(axis=1, keepdims=True))

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each text, none of them empty: windows vote by their bytes."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        windows = -(-sizes // WINDOW)
        flat = np.frombuffer(b"".join(t.ljust(int(k) * WINDOW, b"\0") for t, k in zip(texts, windows, strict=True)), dtype=np.uint8)
        odds = self.log_odds(flat.reshape(-1, WINDOW))
        starts = np.cumsum(windows) - windows
        share = np.full(int(windows.sum()), float(WINDOW))
        share[starts + windows - 1] = sizes - (windows - 1) * WINDOW
        mean = np.add.reduceat(odds * share[:, None], starts, axis=0) / sizes[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def train(windows: list[bytes], labels: list[str], size: int = 8, per_width: int = 8, epochs: int = 8, batch: int = 64, rate: float = 5e-3, seed: int = 7) -> Network:
    """Adam on the cross-entropy; only the positions of the maxima pass gradients back."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    x = np.zeros((len(windows), WINDOW + _PAD), dtype=np.int64)
    for k, w in enumerate(windows):
        x[k, : min(len(w), WINDOW)] = np.frombuffer(w[:WINDOW], dtype=np.uint8)
    emb = rng.normal(0, 0.5, (256, size))
    par = {"e": emb, "v": rng.normal(0, 0.2, (per_width * len(WIDTHS), len(languages))), "c": np.zeros(len(languages))}
    for w in WIDTHS:
        par[f"f{w}"] = rng.normal(0, (2 / (w * size)) ** 0.5, (w, size, per_width))
        par[f"b{w}"] = np.zeros(per_width)
    par = {k: v.astype(np.float32) for k, v in par.items()}
    mean, var = ({k: np.zeros_like(v) for k, v in par.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(x), batch):
            some = order[low : low + batch]
            xb, n = x[some], len(some)
            grown, where = [], []
            for w in WIDTHS:
                z = sum((par["e"] @ par[f"f{w}"][j])[xb[:, j : j + WINDOW]] for j in range(w)) + par[f"b{w}"]
                at = z.argmax(axis=1)
                where.append(at)
                grown.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
            m = np.concatenate(grown, axis=1)
            a = np.maximum(m, 0)
            s = a @ par["v"] + par["c"]
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[some]] -= 1
            p /= n
            grad = {"v": a.T @ p, "c": p.sum(axis=0), "e": np.zeros_like(par["e"])}
            dm = (p @ par["v"].T) * (m > 0)
            for k, w in enumerate(WIDTHS):
                d = dm[:, k * per_width : (k + 1) * per_width]
                grad[f"b{w}"] = d.sum(axis=0)
                g = np.zeros_like(par[f"f{w}"])
                for j in range(w):
                    byte = np.take_along_axis(xb, where[k] + j, axis=1)
                    g[j] = np.einsum("nf,nfe->ef", d, par["e"][byte])
                    np.add.at(grad["e"], byte, d[:, :, None] * par[f"f{w}"][j].T[None])
                grad[f"f{w}"] = g
            step += 1
            for key, g in grad.items():
                mean[key] = 0.9 * mean[key] + 0.1 * g
                var[key] = 0.999 * var[key] + 0.001 * g * g
                par[key] -= (rate * (mean[key] / (1 - 0.9**step)) / (np.sqrt(var[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, par["e"], [par[f"f{w}"] for w in WIDTHS], [par[f"b{w}"] for w in WIDTHS], par["v"], par["c"])


def held_out(id_column: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Network | None:
    """A network from a sample of the labelled rows that are not held out; None if there are none.

    The sample is drawn by a hash of id and text, language by language, in one pass over the rows.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = known.groupBy(F.col(label_col).cast("string").alias("label")).agg(F.count("*").alias("n")).collect()
    if not counts:
        return None
    each = max(1, min(DOCS_PER_LANGUAGE, TRAINING_DOCS // len(counts)))
    rate = docs.sparkSession.createDataFrame([(r["label"], min(1.0, each / r["n"])) for r in counts], "label string, rate double")
    text = F.col(text_col).cast("string")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(id_col)), 11) / float(1 << 53)
    spot = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col(id_col)), F.greatest(F.length(text) - WINDOW // 2, F.lit(1)))
    cut = F.array(*[F.substr(text, (spot(k) + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS_PER_DOC)])
    drawn = known.select(F.col(label_col).cast("string").alias("label"), cut.alias("windows"), draw.alias("draw"), F.xxhash64(text).alias("tie")).join(F.broadcast(rate), "label").where("draw < rate")
    rows = drawn.orderBy("draw", "tie", "label").limit(2 * each * len(counts)).select("label", "windows").collect()
    pairs = [(w.encode(), r["label"]) for r in rows for w in dict.fromkeys(r["windows"]) if w]
    return train([w for w, _ in pairs], [label for _, label in pairs]) if pairs else None


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode()))


def identify(docs: DataFrame, net: Network | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns keep, and lang_pred and score (names after prefix).

    A text without a letter, or a null one, is und with score 0; so is every text where nothing could
    be learned. Whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = [f"{prefix}lang_pred", f"{prefix}score"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        reader = Reader(shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            good = [k for k, t in enumerate(texts) if t and has_letter(t)] if reader else []
            for low in range(0, len(good), 256):
                some = good[low : low + 256]
                best, p = reader.documents([texts[k] for k in some])
                for k, b, q in zip(some, best.tolist(), p.tolist(), strict=True):
                    lang[k], score[k] = reader.net.languages[b], q
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, *names])

    chosen = docs.select(F.col(text_col).cast("string").cast("binary").alias("__text"), *keep)
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    return chosen.mapInArrow(rows, schema)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null texts and those without a letter are und; a null id is not held out and not learned from;
    rows that repeat an id or a text each give a row; texts are read whole, however long; an empty
    table gives no rows; other columns are ignored.
    """
    net = train_on(docs, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return identify(rows, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """docs whose language is found with a score of at least least; all columns stay."""
    net = train_on(docs, id_col, text_col, label_col)
    rows = docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__seen"))
    return identify(rows, net, "__seen", ("__row",), "__").where((F.col("__lang_pred") != UNKNOWN) & (F.col("__score") >= least)).select("__row.*")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    return predict_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
