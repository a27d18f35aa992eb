"""Words cut into the longest pieces of a vocabulary, from the left, for very many words at once.

A word is taken with a space before it. Substrings are compared by hashes from prefix sums, so each step looks up one length for all words side by side.
Every single byte is a piece, so the cut always ends; words are cut in any case at every SPAN bytes, which bounds the steps.

Defined results: an empty word: the space alone; repeated words: the same pieces; bytes of any value; no words: nothing.
"""

from __future__ import annotations

import numpy as np

from tallyweave.llm.bpe import Vocabulary
from tallyweave.llm.shingles import _BACK, _BYTE, _STEP, mix, powers

LONGEST, SPAN = 10, 48


class Pieces:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(LONGEST, 1, -1):
            some = [(b, i) for i, b in enumerate(vocabulary.bytes) if len(b) == n]
            if some:
                data = np.frombuffer(b"".join(b for b, _ in some), np.uint8).reshape(-1, n)
                hashes = mix((_BYTE[data] * powers("up", _STEP, n)).sum(1, dtype=np.uint64))
                order = np.argsort(hashes)
                maybe = np.zeros(1 << 18, bool)  # by the leading bits, so that most lookups end here
                maybe[hashes >> np.uint64(46)] = True
                self.tables.append((n, maybe, hashes[order], np.array([i for _, i in some], np.int32)[order]))
        self.single = np.zeros(256, np.int32)
        for byte, i in ((b[0], i) for i, b in enumerate(vocabulary.bytes) if len(b) == 1):
            self.single[byte] = i

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all words, one after the other, and how many each has."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        data = np.frombuffer(b" " + b" ".join(words), np.uint8)
        lengths = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(lengths)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers("up", _STEP, len(data)), dtype=np.uint64)])
        down = powers("down", _BACK, len(data))
        spans = -(-lengths // SPAN)
        word = np.repeat(np.arange(len(words)), spans)
        part = np.arange(len(word)) - np.repeat(np.cumsum(spans) - spans, spans)
        at = (ends - lengths)[word] + part * SPAN
        stop = np.minimum(at + SPAN, ends[word])
        unit = np.arange(len(at))
        owners, found = [], []
        while len(unit):
            piece, size = self.single[data[at]], np.ones(len(at), np.int64)
            open_ = np.arange(len(at))
            room = stop - at
            for n, maybe, hashes, ids in self.tables:
                some = open_[room[open_] >= n]
                if not len(some):
                    continue
                from_ = at[some]
                h = mix((sums[from_ + n] - sums[from_]) * down[from_])
                likely = np.flatnonzero(maybe[h >> np.uint64(46)])
                place = np.minimum(np.searchsorted(hashes, h[likely]), len(hashes) - 1)
                hit = hashes[place] == h[likely]
                found_ = some[likely[hit]]
                if len(found_):
                    piece[found_], size[found_] = ids[place[hit]], n
                    open_ = open_[size[open_] == 1]
            owners.append(unit)
            found.append(piece)
            at = at + size
            more = at < stop
            at, stop, unit = at[more], stop[more], unit[more]
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(found)[order], np.bincount(word[owner], minlength=len(words))
