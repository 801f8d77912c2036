import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleloom.functions import similarity as S


def slow_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(row[j], above[j + 1])
    return row[-1]


@given(st.text("abc工程 ", max_size=30), st.text("abc工程 ", max_size=30))
@settings(max_examples=200, deadline=None)
def test_common_subsequence(a, b):
    assert S.common_subsequence(a, b) == slow_subsequence(a, b)


@given(st.lists(st.text("ab工程信", max_size=40), min_size=1, max_size=20), st.text("ab工程信", max_size=40))
@settings(max_examples=200, deadline=None)
def test_sequence_ratios_equal_difflib(values, target):
    expected = [SequenceMatcher(None, v, target).ratio() for v in values]
    assert S.TextBlock(values).sequence_ratios(target).tolist() == expected


def test_sequence_ratios_of_long_texts():
    rng = random.Random(5)
    values = ["".join(rng.choice("abcdef") for _ in range(n)) for n in (0, 1, 63, 64, 65, 150, 250)]
    for target in values:
        expected = [SequenceMatcher(None, v, target).ratio() for v in values]
        assert S.TextBlock(values).sequence_ratios(target).tolist() == expected


def test_only_marked_texts_are_scored():
    found = S.TextBlock(["ab", "ab", "x" * 80]).sequence_ratios("ab", only=np.array([True, False, True]))
    assert found.tolist() == [1.0, 0.0, 0.0]


@given(st.lists(st.sampled_from(["red", "blue", "ring", "rings", "工程"]), max_size=5),
       st.lists(st.sampled_from(["red", "blue", "ring", "rings", "工程"]), max_size=5))
@settings(max_examples=150, deadline=None)
def test_token_set_properties(left, right):
    a, b = " ".join(left), " ".join(right)
    score = S.token_set_similarity(a, b)
    assert 0.0 <= score <= 1.0
    assert score == S.token_set_similarity(b, a)
    if left and right and (set(left) <= set(right) or set(right) <= set(left)):
        assert score == 1.0
    if not left or not right:
        assert score == 0.0
    if left and right and not set(left) & set(right):
        x, y = " ".join(sorted(set(left))), " ".join(sorted(set(right)))
        assert score == pytest.approx(2 * slow_subsequence(x, y) / (len(x) + len(y)))


def test_token_set_shared_words():
    # shared "fuzzy", own "was"/"wuzzy": best of the three ratios
    x, y = "fuzzy was", "fuzzy wuzzy"
    joined = 2 * slow_subsequence(x, y) / (len(x) + len(y))
    shared = 2 * 5 / (5 + len(x))
    assert S.token_set_similarity("fuzzy was", "wuzzy fuzzy") == pytest.approx(max(joined, shared))


def test_pair_columns(spark):
    rows = [("工程技术", "技术工程"), (None, "a"), ("small ring", "ring small")]
    df = spark.createDataFrame(rows, "a string, b string")
    found = df.select(
        S.sequence_ratio(F.col("a"), F.col("b")).alias("s"), S.token_set_ratio(F.col("a"), F.col("b")).alias("t")
    ).collect()
    assert [r["s"] for r in found] == [SequenceMatcher(None, a or "", b).ratio() for a, b in rows]
    assert [r["t"] for r in found] == [S.token_set_similarity(a or "", b) for a, b in rows]


def test_contains_similarity(spark):
    df = spark.createDataFrame([("ＡＢ  c", "b C"), ("x", "y"), (None, "y"), ("x", "")], "a string, b string")
    assert [r[0] for r in df.select(S.contains_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 1.0]


def test_cache_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(S, "CACHED_VALUES", 3)
    cache = {}
    for keys in (["a", "b", "a"], ["c", "d", "a"], ["e", "f", "g", "h"]):
        assert S.each_once(keys, cache, lambda ks: [k.upper() for k in ks]) == [k.upper() for k in keys]


def test_a_step_and_a_cache_are_bounded():
    """Neither the size of a batch nor the number of values a task has met makes a step or its cache larger."""
    steps, cache = [], {}
    compute = lambda ks: [steps.append(len(ks)) or k.upper() for k in ks]
    for at in range(0, 100, 10):
        keys = [f"k{i}" for i in range(at, at + 10)] * 2
        assert S.each_once(keys, cache, compute, step=4, most=15) == [k.upper() for k in keys]
        assert len(cache) <= 15
    assert max(steps) == 4 and len(steps) == 100


def test_many_rules_in_steps(spark, monkeypatch):
    monkeypatch.setattr(S, "SCORES", 6)
    rows = [(f"value {i}", f"{i:03d}") for i in range(20)] + [(None, None)]
    df = spark.createDataFrame(rows, "v string, c string").coalesce(1)
    targets, codes = ["value 3", "other", "value"], ["003", "", "007"]
    folded = df.select("v", "c", S.fuzzy_fold(targets, codes, [0.99, 0.99, 2.0], [1.0, 0.5, 0.25], "sequence")("v", "c").alias("z")).collect()
    scored = df.select("v", S.fuzzy_scores(targets, "sequence")("v").alias("z")).collect()
    for r, s in zip(folded, scored):
        want = [S.sequence_similarity(r["v"] or "", t) for t in targets]
        assert s["z"] == want
        same = [c != "" and c == r["c"] for c in codes]
        assert r["z"]["any"] == (any(same) or max(want[:2]) >= 0.99)
        assert r["z"]["total"] == pytest.approx(sum(w * (1.0 if e else x) for w, e, x in zip([1.0, 0.5, 0.25], same, want)))
