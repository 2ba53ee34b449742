"""Hashed 5-word shingles of whole texts, computed for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, SHINGLE_WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BASE = np.uint64(_STEP)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x + np.uint64((seed * 2 + 1) * _STEP % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text.

    Words are runs without ASCII white space; A-Z are lower-cased.
    """
    joined = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", dtype=np.uint8)
    space = _IS_SPACE[joined]
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    first = np.empty(len(inside), dtype=bool)
    first[0] = True
    np.not_equal(inside[1:], inside[:-1] + 1, out=first[1:])
    at = np.flatnonzero(first)
    lengths = np.diff(np.append(at, len(inside)))
    place = np.arange(len(inside)) - np.repeat(at, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE | np.uint64(1), dtype=np.uint64))
    words = mixed(np.add.reduceat(_BYTE[joined[inside]] * powers[place], at))
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(inside[at], ends)
    return words, np.diff(np.concatenate([[0], upto]))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: all 5-word windows, or the whole
    sequence of words where there are fewer; nothing without words."""
    words, counts = word_hashes(texts)
    k = SHINGLE_WORDS
    if len(words) >= k:
        windows = sum(words[i:len(words) - k + 1 + i] * _PLACE[i] for i in range(k))
        windows = mixed(windows, 1)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= k:
            sets.append(np.unique(windows[at:at + n - k + 1]))
        elif n:
            short = (words[at:at + n] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + n * _PLACE[k:]
            sets.append(mixed(short, 2))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
        at += n
    return sets
