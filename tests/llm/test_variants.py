"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

from ruleloom.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    near, shortened = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            shortened[w[:i] + w[i + 1 :], i].add(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in shortened.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}


def found(docs):
    return {r["word"]: tuple(r)[1:] for r in variants.report(docs).collect()}


def misspelt(rng, word, letters):
    at = rng.randrange(len(word) + 1)
    return rng.choice([word[:at] + rng.choice(letters) + word[at:], word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at + 1 :]])


def test_neighbours_forms_and_roots(documents):
    rng = random.Random(8)
    letters = "abAéß×ÿ"
    known = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 16))) for _ in range(60)]
    known += ["aaaaa" * k for k in (1, 2, 3)] + ["straßenbahnhaltestelle", "straßenbahnhaltestellen"]
    pool = [w for w in known for _ in range(rng.randrange(1, 12))]
    pool += [misspelt(rng, w, letters) for w in known for _ in range(12)]
    pool += [misspelt(rng, w, letters) for w in pool]
    texts = [" ".join(rng.choices(pool, k=60)) + ".,1" for _ in range(120)]
    result = found(documents(texts).repartition(3))
    assert result == plain(enumerate(texts))
    assert any(v[1] != v[0] and v[0] for v in result.values())  # a root beyond the form


def test_words_in_small_batches(spark, documents):
    rng = random.Random(9)
    texts = [" ".join(misspelt(rng, "wordings", "abcd") for _ in range(30)) for _ in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(documents(texts)) == plain(enumerate(texts))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_very_long_words_share_their_nodes(documents):
    long = "abcdefghij" * 60
    texts = [" ".join([long, long + "k", long[:-1], "x" + long, long[:300] + "z" + long[300:]])] * 4 + [long] * 3
    result = found(documents(texts))
    assert result == plain(enumerate(texts)) and result[long][3] == 4


def test_odd_rows_and_an_empty_table(odd, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd) == plain(rows)
    ids = [None, 1, 1, 2]
    assert found(documents(["Words words WORDS"] * 4, ids=ids)) == plain([(i, "Words words WORDS") for i in ids])
    assert found(documents([])) == {}
