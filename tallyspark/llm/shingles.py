"""Words and word shingles as 64-bit hashes, a batch of texts at a time.

Words are ``[^\\x20\\x09-\\x0D]+``. Each different word of a batch is handled once.
"""

from __future__ import annotations

import numpy as np
import xxhash

_REMEMBERED = 1 << 18  # word hashes a task keeps
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that equal inputs alone give equal outputs."""
    values = values ^ (values >> np.uint64(30))
    values *= _MIX[0]
    values ^= values >> np.uint64(27)
    values *= _MIX[1]
    values ^= values >> np.uint64(31)
    return values


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted different values."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(values) else values


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


class WordHasher:
    """Hashes words; remembers them for the length of a task."""

    def __init__(self) -> None:
        self._known = _Hashes()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self._known.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` words, in text order; none if there are fewer."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    rolled = hashes[:count].copy()
    for shift in range(1, width):
        rolled *= _ODD
        rolled += hashes[shift : shift + count]
    return mixed(rolled)


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z in lower case; null has none."""
    return text.lower().split() if text else []


def shingle_sets(
    texts: list[bytes | None], width: int, hasher: WordHasher
) -> list[np.ndarray]:
    """Per text its sorted distinct shingles of ``width`` words.

    A text with fewer words is one shingle, one without words none.
    """
    sets = []
    for text in texts:
        own = hasher.hashes(lower_words(text))
        sets.append(distinct(windows(own, min(width, len(own)))) if len(own) else own)
    return sets
