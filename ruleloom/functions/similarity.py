"""Text similarities: plain containment is native, the two ratio measures are Arrow UDFs.

The UDFs are of the iterator kind, so one task prepares its targets once and scores each distinct
value once, however often it occurs in the rows of the task; rows are never shuffled for it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ruleloom.functions.text import normalize_spaces

# Executors need not have this package installed for the UDFs below.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHED_VALUES = 200_000  # memory bound of the per-task cache; it never changes a result
SHORT_TEXT = 64  # texts up to here are scored in step; the measure itself changes its ways from 200 characters on
CELLS = 4 << 20  # size of the comparison matrix of one step
FOLDED_VALUES = 20_000  # the same bound for folded scores, whose batches are of 10 000 rows by default
SCORES = 1 << 20  # scores of one step, and scores that a task's cache holds


def sequence_similarity(a: str, b: str) -> float:
    """2 M / (len a + len b), M being the size of the matching blocks found greedily."""
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def _longest_blocks(equal: np.ndarray, some: np.ndarray, row: np.ndarray, stretch: tuple) -> tuple:
    """The longest common block of each stretch, the earliest on ties: size and both starts.

    ``equal[i, j]`` tells for all texts whether character i equals character j of the target. Size and place of a
    block make up one number whose maximum is the block looked for.
    """
    a_lo, a_hi, b_lo, b_hi = stretch
    n, width = len(row), equal.shape[1]
    in_b = [(b_lo <= j) & (j < b_hi) for j in range(width)]
    none = np.zeros(n, np.int64)
    best = none.copy()
    above = [none] * (width + 1)  # sizes of the blocks that end in the line before, one place to the left
    for i in range(int(a_lo.min()), int(a_hi.max())):
        in_a = (a_lo <= i) & (i < a_hi)
        line = [none]
        for j in range(width):
            if not some[i, j]:
                line.append(none)
                continue
            live = equal[i, j].take(row)
            live &= in_a
            live &= in_b[j]
            size = above[j] + 1
            size *= live
            np.maximum(best, (size << 32) - (i * width + j), out=best, where=live)
            line.append(size)
        above = line
    size = (best + 0xFFFFFFFF) >> 32
    place = (size << 32) - best
    return size, place // width + 1 - size, place % width + 1 - size


def _matched_sizes(texts: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Total size of the matching blocks of many texts with one target, all texts in step.

    Takes the longest common block of a stretch, then goes on left and right of it.
    """
    equal = np.ascontiguousarray(texts.T)[:, None, :] == target[None, :, None]
    some = equal.any(axis=2)
    matched = np.zeros(len(texts), np.int64)
    row = np.flatnonzero(equal.any(axis=(0, 1)))
    zero = np.zeros(len(row), np.int64)
    stretch = (zero, lengths[row], zero, np.full(len(row), len(target)))
    while len(row):
        size, a_at, b_at = _longest_blocks(equal, some, row, stretch)
        np.add.at(matched, row, size)
        found = size > 0
        size, a_at, b_at = size[found], a_at[found], b_at[found]
        a_lo, a_hi, b_lo, b_hi = (side[found] for side in stretch)
        sides = zip((a_lo, a_at, b_lo, b_at), (a_at + size, a_hi, b_at + size, b_hi))
        row = np.tile(row[found], 2)
        stretch = tuple(np.concatenate(pair) for pair in sides)
        open_ = (stretch[0] < stretch[1]) & (stretch[2] < stretch[3])
        row, stretch = row[open_], tuple(side[open_] for side in stretch)
    return matched


class TextBlock:
    """Short texts of one batch as a matrix of characters; long ones are scored one by one."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.short = np.flatnonzero(lengths <= SHORT_TEXT)
        self.long = np.flatnonzero(lengths > SHORT_TEXT)
        self.lengths = lengths[self.short]
        width = max(int(self.lengths.max(initial=0)), 1)
        chars = np.array([texts[i] for i in self.short], dtype=f"U{width}")
        self.chars = chars.view(np.uint32).reshape(len(self.short), width)

    def sequence_ratios(self, target: str, only: np.ndarray | None = None) -> np.ndarray:
        """Similarity of each text to the target; ``only`` marks the texts that matter, others get 0."""
        out = np.zeros(len(self.texts))
        wanted = np.ones(len(self.texts), bool) if only is None else only
        vectorised = 0 < len(target) <= SHORT_TEXT
        short = np.flatnonzero(wanted[self.short]) if vectorised else np.empty(0, np.int64)
        rest = self.long if vectorised else np.arange(len(self.texts))
        for i in rest[wanted[rest]]:
            out[i] = sequence_similarity(self.texts[i], target)
        if len(short):
            wide = np.array([target]).view(np.uint32)
            step = max(1, CELLS // (self.chars.shape[1] * len(target)))
            for at in range(0, len(short), step):
                part = short[at : at + step]
                size = _matched_sizes(self.chars[part], self.lengths[part], wide)
                out[self.short[part]] = 2.0 * size / (self.lengths[part] + len(target))
        return out


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the characters of a."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_bits = full
    for ch in b:
        hit = open_bits & masks.get(ch, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(a) - open_bits.bit_count()


def token_set_similarity(a: str, b: str) -> float:
    """Best of the three ratios between shared words, shared + own words of a, shared + own words of b."""
    return _word_set_similarity(set(a.split()), set(b.split()))


def _word_set_similarity(left: set[str], right: set[str]) -> float:
    if not left or not right:
        return 0.0
    both = left & right
    if both and (left <= right or right <= left):
        return 1.0
    shared = " ".join(sorted(both))
    first = " ".join(sorted(left - right))
    second = " ".join(sorted(right - left))
    base = len(shared) + (1 if shared else 0)
    len_a, len_b = base + len(first), base + len(second)
    best = 2.0 * (base + common_subsequence(first, second)) / (len_a + len_b)
    if shared:
        best = max(
            best,
            2.0 * len(shared) / (len(shared) + len_a),
            2.0 * len(shared) / (len(shared) + len_b),
        )
    return best


def _pair_udf(measure):
    @pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cache: dict[tuple[str, str], float] = {}
        for left, right in batches:
            out = []
            for pair in zip(left.fillna(""), right.fillna("")):
                value = cache.get(pair)
                if value is None:
                    if len(cache) >= CACHED_VALUES:
                        cache.clear()
                    value = cache[pair] = measure(*pair)
                out.append(value)
            yield pd.Series(out, dtype="float64")

    return score


def sequence_ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio of two text columns; not symmetric, keep (value, target)."""
    return _pair_udf(sequence_similarity)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Word-set ratio in [0, 1] of two text columns."""
    return _pair_udf(token_set_similarity)(a, b)


def contains_similarity(a: Column, b: Column) -> Column:
    """1.0 where the normalised b occurs in the normalised a, else 0.0."""
    return F.coalesce(F.contains(normalize_spaces(a), normalize_spaces(b)), F.lit(False)).cast("double")


def score_matrix(values: list[str], targets: list[str], kind: str) -> np.ndarray:
    """Similarity of every value (row) to every target (column)."""
    if kind == "sequence":
        block = TextBlock(values)
        columns = [block.sequence_ratios(t) for t in targets]
    else:
        words = [set(v.split()) for v in values]
        columns = [np.array([_word_set_similarity(w, asked) for w in words]) for asked in (set(t.split()) for t in targets)]
    return np.column_stack(columns)


def each_once(keys: list, cache: dict, compute, step: int | None = None, most: int | None = None) -> list:
    """Results for the keys of a batch; ``compute`` gets the distinct keys not met before in this task, ``step`` at a
    time at most. The cache keeps ``most`` results, or those of one batch."""
    fresh = list(dict.fromkeys(k for k in keys if k not in cache))
    if len(cache) + len(fresh) > (CACHED_VALUES if most is None else most):
        cache.clear()
        fresh = list(dict.fromkeys(keys))
    step = step or max(len(fresh), 1)
    for at in range(0, len(fresh), step):
        part = fresh[at : at + step]
        cache.update(zip(part, compute(part)))
    return [cache[k] for k in keys]


def fuzzy_scores(targets: list[str], kind: str):
    """UDF: value -> array of its similarity to every target."""

    step = max(1, SCORES // max(len(targets), 1))

    def compute(values: list[str]) -> np.ndarray:
        return score_matrix(values, targets, kind)  # a row for each value, 8 bytes a score

    @pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, np.ndarray] = {}
        for values in batches:
            yield pd.Series(each_once(values.fillna("").tolist(), cache, compute, step, min(CACHED_VALUES, step)))

    return score.asNondeterministic()  # scored once: the optimizer must not copy it into a filter


def fuzzy_fold(targets: list[str], codes: list[str], thresholds: list[float], weights: list[float], kind: str):
    """UDF: (value, code) -> did any rule hit, did all hit, weighted score of all.

    ``codes[i]`` is the code that lets rule i hit outright, empty where it has none.
    """

    step = max(1, SCORES // max(len(targets), 1))
    rules_of: dict[str, list[int]] = {}
    for i, code in enumerate(codes):
        if code != "":
            rules_of.setdefault(code, []).append(i)

    def compute(pairs: list[tuple[str, str]]) -> list[tuple[bool, bool, float]]:
        values, value_codes = zip(*pairs)
        scores = score_matrix(list(values), targets, kind)
        same = np.zeros(scores.shape, bool)
        for row, own in enumerate(value_codes):
            same[row, rules_of.get(own, [])] = True
        hits = same | (scores >= np.array(thresholds))
        total = np.zeros(len(pairs))
        for i, weight in enumerate(weights):  # added in rule order
            total += np.where(same[:, i], 1.0, scores[:, i]) * weight
        return list(zip(hits.any(axis=1).tolist(), hits.all(axis=1).tolist(), total.tolist()))

    @pandas_udf("any boolean, all boolean, total double")
    def fold(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        cache: dict[tuple[str, str], tuple[bool, bool, float]] = {}
        for values, value_codes in batches:
            pairs = list(zip(values.fillna(""), value_codes.fillna("")))
            yield pd.DataFrame(each_once(pairs, cache, compute, step, FOLDED_VALUES), columns=["any", "all", "total"])

    return fold.asNondeterministic()
