"""PartEnum signatures for Jaccard similarity of sets of 64-bit hashes.

Sets are put into bands of equal size range. Two sets with similarity of at least G
differ in at most K elements, K following from the band. The domain of elements is
partitioned into groups and each group into parts; for each group, subsets of its
parts are enumerated, and the contents of a set in such a subset give a signature.
By the pigeonhole principle similar sets agree in some subset of some group, hence
share a signature; nothing similar is missed.

A set signs its own band and, if a similar set may lie in the band below, that one.
It signs only as many groups as its own largest distance asks for. A subset in which
a set has no element says little and would be shared by many; it is left out when the
set has enough other groups for the pigeonhole argument, else the set signs
all groups, empty subsets included.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np

from scholarq.llm.shingles import mixed

#: Similarity as a fraction: linked if DEN * |A & B| >= NUM * |A | B|.
NUM, DEN = 4, 5
#: Upper end of a band over its lower end.
BAND_RATIO = 1.4
FEWEST = 4  # smaller sets are similar only if equal


@lru_cache
def bands(largest: int = 1 << 40) -> list[int]:
    """The first size of each band."""
    firsts = [1]
    while firsts[-1] < largest:
        firsts.append(max(firsts[-1] + 1, int(firsts[-1] * BAND_RATIO)))
    return firsts


def band_of(size: int) -> int:
    return int(np.searchsorted(bands(), size, side="right")) - 1


def distance(size: int) -> int:
    """Most elements in which a set of this size differs from a similar one that is no smaller."""
    return size * (DEN - NUM) // NUM


@dataclass(frozen=True)
class Layout:
    """Of a band: ``groups`` groups of ``parts`` parts each, of which ``wrong`` may differ."""

    band: int
    most: int
    groups: int
    parts: int
    wrong: int
    subsets: tuple[tuple[int, ...], ...]

    def signed(self, k: int) -> int:
        """Groups that a set with distance ``k`` signs, with some to spare for empty ones."""
        need = -(-(k + 1) // (self.wrong + 1))
        return min(self.groups, need + (0 if self.groups == 1 else 1 + need // 12))


@lru_cache(maxsize=256)
def layout(band: int) -> Layout:
    most = distance(bands()[band + 1] - 1)
    if most <= 4:
        groups, wrong, parts = 1, most, most + 2
    elif most <= 16:
        groups, wrong, parts = -(-(most + 1) // 2), 1, 3
    else:
        groups, wrong, parts = most + 1, 0, 1
    if groups > 1:
        groups += 1 + groups // 12
    return Layout(band, most, groups, parts, wrong, tuple(combinations(range(parts), parts - wrong)))


@lru_cache(maxsize=256)
def _salt(band: int) -> np.ndarray:
    form = layout(band)
    return mixed(np.arange(form.groups * len(form.subsets), dtype=np.uint64), 1000 + band).reshape(form.groups, -1)


def _signed(elements: np.ndarray, scrambled: np.ndarray, form: Layout) -> np.ndarray:
    k = min(distance(len(elements)), form.most)
    limit, cells = form.signed(k), form.groups * form.parts
    where = ((mixed(elements, 100 + form.band) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int32)
    salt = _salt(form.band)
    if form.parts == 1:  # groups are not divided: a signature for each group with elements
        inside = where < limit
        where, part = where[inside], scrambled[inside]
        order = np.argsort(where)
        where = where[order]
        at = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, dtype=np.int64)
        if len(at) > k:
            return mixed(np.add.reduceat(part[order], at) ^ salt[where[at], 0], 5)
        return _all_subsets(elements, scrambled, form, salt, form.groups, False, k)
    return _all_subsets(elements, scrambled, form, salt, limit, True, k)


def _all_subsets(elements, scrambled, form: Layout, salt, limit: int, may_skip: bool, k: int) -> np.ndarray:
    cells = form.groups * form.parts
    where = ((mixed(elements, 100 + form.band) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    content = np.zeros(cells, dtype=np.uint64)
    cell, at = np.unique(where[order], return_index=True)
    content[cell] = np.add.reduceat(scrambled[order], at)
    filled = np.zeros(cells, dtype=bool)
    filled[cell] = True
    content, filled = content.reshape(form.groups, form.parts), filled.reshape(form.groups, form.parts)
    present = np.stack([filled[:, list(s)].any(1) for s in form.subsets], axis=1)
    if form.parts == 1:
        value = content
    else:  # a subset's content: each part's sum times an odd number of its own
        odd = mixed(np.arange(form.parts, dtype=np.uint64), 4) | np.uint64(1)
        value = np.stack([(content[:, list(s)] * odd[list(s)]).sum(1, dtype=np.uint64) for s in form.subsets], axis=1)
    found = mixed(value ^ salt, 5)
    if may_skip and int(present[:limit].all(1).sum()) * (form.wrong + 1) > k:
        return found[:limit][present[:limit]]
    return found.ravel()


def signatures(elements: np.ndarray) -> np.ndarray:
    """The signatures of a set of distinct hashes."""
    size = len(elements)
    if size < FEWEST:
        return np.zeros(0, dtype=np.uint64)
    own, scrambled = band_of(size), mixed(elements, 3)
    found = [_signed(elements, scrambled, layout(own))]
    least = -(-size * NUM // DEN)  # the smallest similar set
    if least < bands()[own] and own > 0 and layout(own - 1).most > 0:
        found.append(_signed(elements, scrambled, layout(own - 1)))
    return np.concatenate(found)


def most_apart(a, b):
    """Largest symmetric difference of two similar sets of these sizes."""
    return a + b - 2 * (-(-NUM * (a + b) // (NUM + DEN)))


def parity_sketch(elements: np.ndarray) -> bytes:
    """One bit per cell: whether an odd number of elements falls there. Two sketches differ in at
    most as many bits as the sets do in elements; halves can be folded together."""
    bits = max(64, 1 << int(2 * max(1, len(elements)) - 1).bit_length())
    cells = (mixed(elements, 6) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes, words: int) -> np.ndarray:
    """A sketch as 64-bit words, folded to ``words`` of them."""
    x = np.frombuffer(sketch, dtype=np.uint64)
    while len(x) > words:
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return x
