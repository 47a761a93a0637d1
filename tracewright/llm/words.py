"""Words of a text as 64-bit hashes, in bulk."""

from __future__ import annotations

import numpy as np
import xxhash

from tracewright.llm.common import LOWER

#: Keeps 0-9, a-z (A-Z lower-cased) and all bytes of characters beyond ASCII; the rest become spaces.
ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)

#: Words kept per worker.
CACHED_WORDS = 150_000


class Hashes(dict):
    """Word to its XXH64; the older half of the words goes when full."""

    def __init__(self, seed: int = 0) -> None:
        super().__init__()
        self.seed, self.older = seed, {}

    def __missing__(self, word: bytes) -> int:
        h = self.older.get(word)
        if h is None:
            h = xxhash.xxh64_intdigest(word, self.seed)
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def space_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    return text.translate(LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.translate(ALNUM).split()
