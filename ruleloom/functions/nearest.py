"""The nearest of many texts by the matching-block ratio, without trying most of them.

The matching blocks of two texts are a common subsequence, whose length is at most the number of characters they share.
So two bounds, both cheap for many pairs at once, tell which pairs may still win:

* shared characters, counted in ``BUCKETS`` classes as a product of two matrices of zeros and ones;
* the longest common subsequence, by bits of a 64-bit number per pair.

The measure itself is taken of the pairs that are left, the most promising first, until no bound reaches the best found.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from ruleloom.functions.similarity import sequence_similarity

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # as in the similarity module

BUCKETS, STEPS = 64, 4  # classes of characters, and how often one counts on its own
ROWS = 128  # values that are compared with all texts at a time
WORD = 64  # characters of a value whose subsequences fit a number


class _Texts:
    """Texts as characters and counts of character classes."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), self.lengths)
        counts = np.bincount(owner * BUCKETS + flat % BUCKETS, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
        self.steps = np.concatenate([counts >= k for k in range(1, STEPS + 1)], axis=1).astype(np.float32)
        self.beyond = np.maximum(counts - STEPS, 0).sum(axis=1)
        self.flat, self.start = flat, np.cumsum(self.lengths) - self.lengths

    def shared(self, rows: slice, others: "_Texts") -> np.ndarray:
        """The most characters that texts may share, in any order."""
        met = (self.steps[rows] @ others.steps.T).astype(np.int64)
        met += np.minimum(self.beyond[rows, None], others.beyond)
        return np.minimum(met, np.minimum(self.lengths[rows, None], others.lengths))


def _subsequences(values: _Texts, first: int, i: np.ndarray, others: _Texts, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs whose value has ``WORD`` characters at most."""
    rows = np.unique(i)
    low, high = values.start[first + rows[0]], values.start[first + rows[-1]] + values.lengths[first + rows[-1]]
    known, code = np.unique(values.flat[low:high], return_inverse=True)
    masks = np.zeros((rows[-1] - rows[0] + 1, len(known) + 1), np.uint64)
    sizes = values.lengths[first + rows[0] : first + rows[-1] + 1]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(high - low) - np.repeat(values.start[first + rows[0] : first + rows[-1] + 1] - low, sizes)
    fits = place < WORD
    np.bitwise_or.at(masks, (owner[fits], code[fits]), np.uint64(1) << place[fits].astype(np.uint64))
    at = np.minimum(np.searchsorted(known, others.flat), len(known) - 1)
    letters = np.where(known[at] == others.flat, at, len(known))  # the last column is empty
    order = np.argsort(-others.lengths[j], kind="stable")
    own, start, lengths = i[order] - rows[0], others.start[j[order]], others.lengths[j[order]]
    open_ = np.full(len(order), np.iinfo(np.uint64).max)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -step, side="left"))  # texts longer than that
        here = open_[:n]
        hit = here & masks[own[:n], letters[start[:n] + step]]
        open_[:n] = (here + hit) | (here - hit)
    size = values.lengths[first + i[order]]
    full = np.where(size >= WORD, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(size, WORD - 1).astype(np.uint64)) - np.uint64(1))
    out = np.empty(len(order), np.int64)
    out[order] = np.bitwise_count(~open_ & full)
    return out


def nearest(values: list[str], best: np.ndarray, best_pos: np.ndarray, texts: list[str], pos: np.ndarray) -> int:
    """Raise ``best`` and ``best_pos`` of each value where a text has a higher ratio, or the same at a lower position.

    Texts that equal a value, lie in it or hold it are no matter here. Returns how many pairs were measured.
    """
    own, others = _Texts(values), _Texts(texts)
    measured = 0

    def measure(a: int, b: int) -> None:
        nonlocal measured
        value, text = values[a], texts[b]
        if value in text or text in value:
            return
        measured += 1
        score = sequence_similarity(value, text)
        if score > best[a] or (score == best[a] and 0.0 < score and pos[b] < best_pos[a]):
            best[a], best_pos[a] = score, pos[b]

    for first in range(0, len(values), ROWS):
        rows = slice(first, min(first + ROWS, len(values)))
        shared = own.shared(rows, others)
        bounds = 2.0 * shared / np.maximum(own.lengths[rows, None] + others.lengths, 1)
        # The most promising text of each value, so that there is a score to reach.
        for i, j in enumerate(np.argmax(bounds, axis=1).tolist()):
            if bounds[i, j] > best[first + i]:
                measure(first + i, j)
        least, place = best[rows], best_pos[rows]
        may_win = lambda bound, i, j: (bound > least[i]) | ((bound == least[i]) & (pos[j] < place[i]))
        i, j = np.nonzero((bounds >= least[:, None]) & (shared > 0))
        bound = bounds[i, j]
        short = np.flatnonzero(own.lengths[first + i] <= WORD)
        if len(short):
            common = _subsequences(own, first, i[short], others, j[short])
            bound[short] = 2.0 * common / (own.lengths[first + i[short]] + others.lengths[j[short]])
        left = may_win(bound, i, j) & (bound > 0.0)
        i, j, bound = i[left], j[left], bound[left]
        order = np.lexsort((pos[j], -bound, i))
        for a, b, most in zip((first + i[order]).tolist(), j[order].tolist(), bound[order].tolist()):
            if most > best[a] or (most == best[a] and pos[b] < best_pos[a]):
                measure(a, b)
    return measured
