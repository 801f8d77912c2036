"""Hard negatives against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from ruleloom.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int, score double, row string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 0.5, "r", 1) for i, v, label in rows], ROWS)


def plain(rows):
    one = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        key = ((label + 1) % 10 if i % 7 == 0 else label, whole)
        one[i] = min(one.get(i, key), key)
    out = []
    for a in (i for i in one if i % 50 == 0):
        scored = [(-sum(x * y for x, y in zip(one[a][1], v)), i, label) for i, (label, v) in one.items() if i != a]
        for p, pid, _ in sorted(s for s in scored if s[2] == one[a][0])[:5]:
            fits = sorted(s for s in scored if s[2] != one[a][0] and 50 * -p <= 100 * -s[0] <= 95 * -p)
            out += [(a, pid, rank, s[1], -p, -s[0]) for rank, s in enumerate(fits[:3], 1)]
    return sorted(out)


def made(seed, n, dimensions, spread=1.0, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels)
        rows.append((i * 5, [c * 0.5 + rng.gauss(0, spread) for c in centres[label]], label))
    return rows


@pytest.mark.parametrize("dimensions, spread", [(2, 1.0), (64, 0.3), (130, 1.0)])
def test_mined_as_by_hand(spark, dimensions, spread):
    rows = made(dimensions, 400, dimensions, spread)
    assert sorted(map(tuple, negatives.report(table(spark, rows).repartition(3)).collect())) == plain(rows) != []


def test_blocks_of_anchors_and_small_steps(spark, monkeypatch):
    rows = made(2, 300, 16)
    for name, value in (("BLOCK_BYTES", 5000), ("ROWS", 7), ("ANCHORS", 3)):
        monkeypatch.setattr(negatives, name, value)
    assert sorted(map(tuple, negatives.report(table(spark, rows).repartition(2)).collect())) == plain(rows)


def test_ties_repeats_and_rows_that_take_no_part(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.25, 0.5]), 0.5, -0.25], rng.randrange(3)) for i in range(120)]
    rows += rows[:20] + [(50, [0.5, 0.5, 0.5], 0), (None, [1.0, 1.0, 1.0], 0), (200, None, 1), (250, [1.0, None, 1.0], 1), (300, [1.0, float("nan"), 0.0], 1)]
    rows += [(350, [float("inf"), 0.0, 0.0], 1), (400, [1.0, 1.0, 1.0], None), (450, [], 1), (-100, [0.5, 0.5], 2), (500, [0.5, 0.5, 0.5, 0.5], 9)]
    assert sorted(map(tuple, negatives.report(table(spark, rows)).collect())) == plain(rows) != []


def test_an_empty_table_and_one_without_anchors(spark):
    assert negatives.report(table(spark, [])).count() == 0
    assert negatives.report(table(spark, [(1, [1.0], 1), (2, [1.0], 1)])).count() == 0


def test_no_score_lies_outside_its_interval():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.integers(-200, 200, (60, 64)), np.zeros((1, 64), np.int64), np.eye(64, dtype=np.int64)[:3]])
    length, codes, aligned, rest = negatives.coded_directions(vectors)
    batch = pa.table({
        "vec_id": np.arange(64), "label": np.zeros(64, np.int64), "vector": pa.array(vectors.tolist()), "length": length,
        "codes": [c.tobytes() for c in codes], "aligned": aligned.tolist(), "rest": rest.tolist(),
    })
    rows = negatives._Rows(batch.combine_chunks().to_batches()[0], 64)
    anchors = negatives.Anchors(np.arange(64), np.zeros(64, np.int64), vectors)
    scores, every = vectors @ vectors.T, np.ones((64, 64), bool)
    for low, high in ((scores, np.inf), (-np.inf, scores), (scores, scores)):
        i, _ = negatives.survivors(rows, anchors, np.arange(64), slice(0, 64), low, high, every)
        assert len(i) == 64 * 64
    i, _ = negatives.survivors(rows, anchors, np.arange(64), slice(0, 64), scores.diagonal()[None], np.inf, every)
    assert len(i) < 64 * 8  # far from all
