"""Token counts under a unigram tokenizer, without its tokens.

Words are counted one by one: an Aho-Corasick automaton of the vocabulary lists the pieces that
end at each character, and dynamic programming keeps the best score up to there and how many pieces
it takes. Ties and unknown characters are treated as the tokenizers library does: of equal scores the
piece that starts first wins; a character that is no piece costs ten more than the worst piece and
counts as its bytes in UTF-8. The name of the unknown piece, where a text spells it, is a piece if it
stands alone, and its bytes next to another unknown one.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.llm.common import held

UNKNOWN_PENALTY = 10.0
UNKNOWN_PIECE = "<unk>"
MARK = "▁"
_MARK = MARK.encode()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class WordCounter(dict):
    """Word (bytes) to the pieces of its mark and itself. At most 2 * limit words are held."""

    def __init__(self, pieces: list[tuple[str, float]], limit: int = 700_000, unknown: str = UNKNOWN_PIECE):
        super().__init__()
        self.limit, self.old = limit, {}
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score, piece == unknown))
        self.automaton.make_automaton()
        self.unknown, self.name_bytes = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY, len(unknown.encode())

    def viterbi(self, text: str) -> tuple[float, int]:
        """Best score of a text and the number of its pieces."""
        # run: bytes of the unknown pieces that end here one after another, not in count yet; -1: the name alone
        score, count, run = [0.0] * (len(text) + 1), [0] * (len(text) + 1), [0] * (len(text) + 1)
        ends: dict[int, list[tuple[int, float, bool]]] = {}
        for last, match in self.automaton.iter(text):
            ends.setdefault(last, []).append(match)
        for last, char in enumerate(text):
            best, at, name, single = None, 0, False, False
            for length, value, unknown in ends.get(last, ()):  # longest first, which is by start
                total = value + score[last + 1 - length]
                if best is None or total > best:
                    best, at, name = total, last + 1 - length, unknown
                single = single or length == 1
            if not single:
                total = self.unknown + score[last]
                if best is None or total > best:
                    best, at, name = total, last, True
            score[last + 1] = best
            if name:
                before = self.name_bytes if run[at] < 0 else run[at]
                count[last + 1], run[last + 1] = count[at], before + len(text[at : last + 1].encode())
                if not before and last > at:
                    run[last + 1] = -1
            else:
                count[last + 1] = count[at] + abs(run[at]) + 1
        return score[-1], count[-1] + abs(run[-1])

    def __missing__(self, word: bytes) -> int:
        n = self.old.get(word)
        if n is None:
            # a mark in the text itself begins a word of its own, as it does in the tokenizer
            n = sum(self.viterbi(MARK + part)[1] for part in word.decode().split(MARK))
            if len(word) > 64:
                return n
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = n
        return n

    def tokens(self, words: list[bytes]) -> int:
        n = sum(map(self.__getitem__, words))
        # no mark is put before a text that begins with one
        return n - self.viterbi(MARK)[1] if words and words[0].startswith(_MARK) else n


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens.

    White space is the six ASCII characters, and each run of it counts as one mark. Null and blank
    texts have no tokens. Null and repeated ids are kept as they come.
    """
    path = path or default_vocabulary()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(("counter", path), lambda: WordCounter(vocabulary(path)))
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or b"").split()
                words.append(len(found))
                tokens.append(counter.tokens(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return chosen.mapInArrow(rows, "doc_id long, n_words long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
