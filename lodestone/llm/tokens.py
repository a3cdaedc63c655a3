"""Token ids of a word-level BPE vocabulary, with the words of plain texts looked up in a cache.

The vocabulary's pre-tokenizer works on lower-cased text between white space, so each run of characters without white
space, and each word in it, has ids of its own. Texts made only of ASCII and Latin letters go that way; any other text (other scripts,
combining marks, control characters, special-token strings) goes to the tokenizer as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np

_PLAIN = [chr(c) for c in range(0x180)]
_LETTERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N")
_WORDS = re.compile(rf"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_NUMBERS}]+")
_NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ]|<\\|")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}


class Memo(dict):
    """Values of ``make`` by key; when ``limit`` are held, all are forgotten."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, key: str) -> bytes:
        value = self._make(key)
        if len(self) >= self._limit:
            self.clear()
        self[key] = value
        return value


class WordIds:
    """``ids(text)`` equals the tokenizer's own ids without special tokens. The cache holds ``cache`` words at most."""

    def __init__(self, path: str, cache: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._letters = self._tokenizer.model, _byte_letters()
        self._of_word = Memo(self._word, cache).__getitem__

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(shown)]).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if _NOT_PLAIN.search(text):
            return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.frombuffer(b"".join(map(self._of_word, _WORDS.findall(text.lower()))), dtype=np.uintc).astype("<u4", copy=False)


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer for each vocabulary and Python worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
