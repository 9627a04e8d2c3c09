"""64-bit hashes of words and of windows of words, for whole batches of texts."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words whose hashes a worker remembers; a full store is emptied.
REMEMBERED = 120_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word, computed once while the store holds it."""

    def __missing__(self, word: str) -> int:
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


_known = WordHashes()


def forget() -> None:
    """Drops the remembered words from this worker."""
    _known.clear()


def words_of(text: str | None) -> list[str]:
    """Lower-case words between white space; none for null."""
    return text.lower().split() if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    """uint64 hashes of words."""
    if len(_known) > REMEMBERED:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of uint64 values over all bits."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words; fewer words are one window, none have none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = out * _ODD + hashes[k : n - width + 1 + k]
    return mix(out)
