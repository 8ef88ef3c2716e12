"""Whole texts to token ids with the tokenizers library, and a word cache that keeps its ids exact."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dyadspark.llm.common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
assert sys.byteorder == "little" and array("I").itemsize == 4


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters that NFC leaves alone and that have a lower case of one letter; then marks, without those that begin special tokens or contractions.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return table


class WordEncoder(dict):
    """Word to its ids, as little-endian unsigned 32-bit integers.

    The tokenizer file drops white space before it looks at words, so a text's ids are those of its
    pieces between spaces and line ends, one after the other; pieces that recur are looked up. Files
    that treat white space in any other way are given whole texts instead. At most 2 * limit words
    are held.
    """

    def __init__(self, path: str, limit: int = 700_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.path, self.limit, self.old = path, limit, {}
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and first.get("behavior") == "Removed" and first.get("invert") is True and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.marks: dict[str, bytes] = {}
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _marks(self, run: str) -> bytes:
        if run not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[run] = self._slow(run)
        return self.marks[run]

    def _fresh(self, word: str) -> bytes:
        if m := _PLAIN.fullmatch(word):
            low = m[1].lower()
            spelt = low if low.isascii() else "".join(map(self.letters.__getitem__, low.encode()))
            ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            return ids + self._marks(m[2]) if m[2] else ids
        return self._slow(word)

    def __missing__(self, word: str) -> bytes:
        if not word:
            return b""
        ids = self.old.get(word)
        if ids is None:
            ids = self._fresh(word)
            if len(word) > 64:
                return ids
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text, without special tokens; none for null."""
        if not text:
            return b""
        if not self.by_word:
            return self._slow(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def documents(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a batch. Its different words are looked up once each."""
        if not self.by_word:
            return [self.ids(t.as_py()) for t in texts]
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        found = list(map(self.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat, start = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(size) - size
        at = words.indices.to_numpy()
        n = size[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(start[at] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        ends = (4 * upto[split.offsets.to_numpy()]).tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encoder(path: str, words: int = 700_000) -> WordEncoder:
    """One encoder for each file and Python worker; it remembers twice so many words at most."""
    return held(("encoder", path, words), lambda: WordEncoder(path, words))
