"""Sets of word shingles, as sorted 64-bit hashes, computed for many texts at once.

Words are what ASCII white space parts, with A-Z lower-cased. A text with fewer words than a shingle has its whole
sequence as its only one; a text without words has none.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_RNG.integers(1, 2**62, dtype=np.uint64)) * 4 + 1
_BACK = pow(_STEP, -1, 2**64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order."""
    x = x + np.uint64(int(salt) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(name: str, base: int, n: int) -> np.ndarray:
    found = _powers.get(name)
    if found is None or len(found) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        found = _powers[name] = np.multiply.accumulate(steps)
    return found[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin; one more place for the end. texts: lower-cased already."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    white = _WHITE[data]
    edge = np.diff(np.concatenate([[True], white]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.cumsum(_BYTE[data] * powers("up", _STEP, len(data)), dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = mix((sums[ends - 1] - before) * powers("down", _BACK, len(data))[starts])
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, firsts)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """A sorted array of distinct shingle hashes for each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    hashes, cuts = word_hashes(raw)
    n = len(hashes)
    out = []
    if n >= words:
        rolled = np.zeros(n - words + 1, np.uint64)
        for i in range(words):
            rolled += mix(hashes[i : n - words + 1 + i], i + 1)
        rolled = mix(rolled)
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for i in range(b - a):
                short += mix(hashes[a + i : a + i + 1], i + 1)
            out.append(mix(short, 1000 + b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A signed 64-bit identifier of each set's contents."""
    return np.array([mix(np.add.reduce(mix(s, 7), dtype=np.uint64, keepdims=True), len(s))[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)
