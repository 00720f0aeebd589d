"""Five-word shingles of a text as sorted distinct 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

WIDTH = 5
CACHE_WORDS = 120_000
# Odd multipliers, one for each place in a shingle; short texts use the same ones after a start of their own.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                  dtype=np.uint64)


def texts_of(column) -> list[bytes | None]:
    """An Arrow column of strings as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """Hash of each word, kept once computed."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Keeps the word hashes it has seen; one for each task."""

    def __init__(self) -> None:
        self.known = WordHashes()

    def of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes of a UTF-8 text: of every five words in a row, or of all words if there are fewer."""
        # bytes.split() cuts at exactly the white space of the word rule, and bytes.lower() changes A-Z only.
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = len(h) - WIDTH + 1
        if n < 1:
            mixed = (h * PLACES[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h))
        else:
            mixed = h[:n] * PLACES[0]
            for k in range(1, WIDTH):
                mixed += h[k:n + k] * PLACES[k]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xE9846AF9B1A615D5)
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def set_class(shingles: np.ndarray) -> int:
    """One signed 64-bit id for equal sets."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))
