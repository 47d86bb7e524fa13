"""Hashes of words and of word shingles, for many documents at once in numpy.

A word's hash comes from prefix sums of a polynomial over its bytes, so all words of a slice of texts
cost a few passes over the bytes. All arithmetic is modulo 2**64; hashes are the same in every process.
"""

from __future__ import annotations

import numpy as np

#: A-Z in lower case, all other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_RND = np.random.default_rng(20240229)
BYTE = _RND.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = _RND.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit integer over all others."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of an array of bytes start and end."""
    word = np.concatenate([[False], ~BLANK[raw], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes that are no white space, A-Z in lower case), and for each
    text where its words start in that list (one more entry than texts)."""
    raw = np.frombuffer(b"\n".join([t.translate(LOWER) for t in texts]) + b"\n", np.uint8)
    starts, ends = word_bounds(raw)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * powers(BASE, len(raw))[:-1], dtype=np.uint64)])
    hashes = mix((prefix[ends] - prefix[starts]) * powers(INVERSE, len(raw))[starts])
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(starts, first)


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(words) - width + 1
    out = np.full(max(n, 0), width, np.uint64)
    for k in range(width):
        out += words[k : k + max(n, 0)] * PLACE[k]
    return mix(out)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; one for a text of fewer words, none for one without words."""
    words, at = word_hashes(texts)
    return [np.unique(run_hashes(words[a:b], min(width, b - a))) if b > a else np.zeros(0, np.uint64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
