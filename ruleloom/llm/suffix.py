"""Suffix arrays by induced sorting, of one shard of text in memory.

Suffixes are classified as larger or smaller than their successor. The leftmost smaller ones (LMS) are put in order by
inducing from their first bytes, named by equal LMS substrings, and sorted by the suffix array of the names; all other
suffixes are then induced from them. On bytes a whole bucket is induced at a time by numpy; the names, an alphabet as
large as the text, are induced one by one.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from ruleloom.llm import tokens as K

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDE = 300  # alphabets up to this size are induced by the bucket


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last is larger than the empty one."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    following = np.searchsorted(differs, np.arange(n))
    result = np.zeros(n, bool)
    has = following < len(differs)
    at = differs[following[has]]
    result[has] = text[at] < text[at + 1]
    return result


def _dealt(suffixes: np.ndarray, chars: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    order = np.argsort(chars, kind="stable")
    chars, suffixes = chars[order], suffixes[order]
    heads = np.flatnonzero(np.diff(chars, prepend=-1))
    for begin, end in zip(heads.tolist(), [*heads[1:].tolist(), len(chars)]):
        buckets[chars[begin]].append(suffixes[begin:end])


def _induced_wide(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes, given that of the LMS suffixes, bucket by bucket."""
    none = np.zeros(0, np.int64)
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    _dealt(lms, text[lms], seeds)
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    last = len(text) - 1
    if not smaller[last]:
        larger[text[last]].append(np.array([last]))
    done_larger = []
    for c in range(size):
        done, todo = [], larger[c]
        while todo:
            now = np.concatenate(todo)
            done.append(now)
            larger[c] = todo = []
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _dealt(before, text[before], larger)
                todo = larger[c]
        for seed in seeds[c]:
            before = seed[seed > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _dealt(before, text[before], larger)
        done_larger.append(np.concatenate(done) if done else none)
    rising: list[list[np.ndarray]] = [[] for _ in range(size)]
    done_smaller = []
    for c in range(size - 1, -1, -1):
        done, todo = [], rising[c]
        while todo:
            now = np.concatenate(todo)
            done.append(now)
            rising[c] = todo = []
            before = now[now > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _dealt(before, text[before], rising)
                todo = rising[c]
        now = done_larger[c][::-1]
        before = now[now > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _dealt(before, text[before], rising)
        done_smaller.append((np.concatenate(done) if done else none)[::-1])
    parts = [x for c in range(size) for x in (done_larger[c], done_smaller[size - 1 - c])]
    return np.concatenate(parts)


def _induced_plain(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The same, one suffix at a time."""
    counts = np.bincount(text, minlength=size)
    tails = np.cumsum(counts)
    letters, falls = text.tolist(), (~smaller).tolist()
    order = [-1] * len(letters)
    ends = tails.tolist()
    for suffix in lms[::-1].tolist():
        ends[letters[suffix]] -= 1
        order[ends[letters[suffix]]] = suffix
    heads = (tails - counts).tolist()
    last = len(letters) - 1
    if falls[last]:
        order[heads[letters[last]]] = last
        heads[letters[last]] += 1
    for place in range(len(order)):
        before = order[place] - 1
        if before >= 0 and falls[before]:
            order[heads[letters[before]]] = before
            heads[letters[before]] += 1
    ends = tails.tolist()
    for place in range(len(order) - 1, -1, -1):
        before = order[place] - 1
        if before >= 0 and not falls[before]:
            ends[letters[before]] -= 1
            order[ends[letters[before]]] = before
    return np.array(order, np.int64)


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` (numbers below ``size``) in their order."""
    text = text.astype(np.int64)
    if len(text) < 2:
        return np.arange(len(text))
    smaller = _smaller(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = _induced_wide if size <= WIDE else _induced_plain
    rough = induce(text, smaller, lms, size)
    if len(lms) < 2:
        return rough
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    # An LMS substring reaches to the next LMS place; equal hashes and lengths are equal substrings.
    ends = np.append(lms[1:] + 1, len(text))
    sums = K.prefix_sums(K.mix(text.view(np.uint64) + np.uint64(1)))
    hashes, lengths = np.zeros(len(text), np.uint64), np.zeros(len(text), np.int64)
    hashes[lms], lengths[lms] = K.stretch_hashes(sums, lms, ends), ends - lms
    hashes, lengths = hashes[ordered], lengths[ordered]
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (lengths[1:] != lengths[:-1])
    names = np.zeros(len(text), np.int64)
    names[ordered] = np.cumsum(fresh) - 1
    count = int(fresh.sum())
    if count < len(lms):
        ordered = lms[suffix_array(names[lms], count)]
    return induce(text, smaller, ordered, size)


def repeated_starts(text: np.ndarray, order: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """The valid starts whose first ``length`` bytes also start elsewhere.

    A suffix with a partner has one beside it in the suffix array; the common prefix with that neighbour is looked at
    in the order of the text (permuted), and needs to be known only as far as ``length``.
    """
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    sums = K.prefix_sums(K.mix(text.astype(np.uint64) + np.uint64(1)))
    here = np.flatnonzero(valid & (before >= 0))
    here = here[valid[before[here]]]
    there = before[here]
    same = K.stretch_hashes(sums, here, here + length) == K.stretch_hashes(sums, there, there + length)
    found = np.zeros(len(text), bool)
    found[here[same]] = True
    found[there[same]] = True
    return np.flatnonzero(found)
