"""The bounded search against all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from ruleloom.functions.nearest import nearest


def by_hand(value, texts, least, least_pos):
    best, place = least, least_pos
    for pos, text in enumerate(texts):
        if value in text or text in value:
            continue
        score = SequenceMatcher(None, value, text).ratio()
        if score > best or (score == best and 0 < score and pos < place):
            best, place = score, pos
    return best, place


@pytest.mark.parametrize("letters, longest", [("ab", 7), ("abcdefgh ", 30), ("信息工程管理科学数据与计算机语言文学", 9), ("abcé𝒳", 150)])
def test_as_by_hand(letters, longest):
    rng = random.Random(longest)
    made = lambda n: ["".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(n)]
    values, texts = made(150), list(dict.fromkeys(made(120)))
    best = np.array([rng.choice([0.0, 0.0, 0.5, 0.9]) for _ in values])
    place = np.array([np.inf if b == 0.0 else float(rng.randrange(len(texts))) for b in best])
    expected = [by_hand(v, texts, b, p) for v, b, p in zip(values, best.tolist(), place.tolist())]
    nearest(values, best, place, texts, np.arange(len(texts)))
    assert list(zip(best.tolist(), place.tolist())) == expected


def test_few_pairs_are_measured():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(400)]
    values = [t[:6] + "_" + t[7:] for t in texts]
    best, place = np.zeros(400), np.full(400, np.inf)
    assert nearest(values, best, place, texts, np.arange(400)) < 2 * 400
    assert (place == np.arange(400)).all()
