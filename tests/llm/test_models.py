"""The trained operators against plain Python or held-out accuracy, and on odd rows; the pipeline's stages."""

import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ruleloom.llm import language, lm, toxicity
from ruleloom.llm.oracles import ORACLES
from ruleloom.llm.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


# ---------------------------------------------------------------- language model


def expected_scores(texts):
    tokens = [words(t) + [None] for t in texts]
    train = [t for i, t in enumerate(tokens) if crc(i, 7) != 2]
    c = Counter(w for t in train for w in t)
    pairs, total = Counter(p for t in train for p in zip([0, *t], t)), sum(c.values())
    p = {w: (c[w] + 1) / (total + len(c) + 1) for t in tokens for w in t}

    def arc(v, w):
        seen = len(train) if v == 0 else c[v]
        return math.log10((pairs[v, w] + lm.STRENGTH * p[w]) / (seen + lm.STRENGTH))

    return [(len(t), sum(c[w] > 0 for w in t), total, sum(math.log10(p[w]) for w in t), sum(arc(v, w) for v, w in zip([0, *t], t))) for t in tokens]


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_scores_equal_plain_python(documents, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "RANGE_BYTES", block // 2)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b C c é long-word x,".split()) for _ in range(rng.randrange(30))) for _ in range(40)] + [None, " "]
    found = sorted(lm.report(documents(texts)).collect(), key=lambda r: r["doc_id"])
    for row, expected in zip(found, expected_scores(texts)):
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == expected[:3]
        assert (row["base_score"], row["score"]) == pytest.approx(expected[3:]) and row["held_out"] == (crc(row["doc_id"], 7) == 2)


def test_arcs_of_a_state_sum_to_one(documents, spark):
    """Over all words and the end, from the state of one word."""
    texts = ["a b", "a c b", "b a", "c"] + ["a " + w for w in ("a", "b", "c", "zz")] + ["a"]
    train = {i: crc(i, 7) != 2 for i in range(len(texts))}
    rows = lm.scored(documents(texts), lm.F.col("doc_id") < 4).collect()
    score = {r["id"]: r["score"] for r in rows}
    assert train and rows[0]["train_tokens"] == 12
    # P(begin a) * sum over the next token (P(end) is that of "a" alone); "zz" stands for the one unknown word.
    begin = lm.scored(documents(["a b", "a c b", "b a", "c", "a"]), lm.F.col("doc_id") < 4).collect()
    known = expected = 0.0
    c, pairs, n, v, s = Counter("aabbbacc"), None, 12, 4, lm.STRENGTH
    c = Counter({"a": 3, "b": 3, "c": 2, None: 4})
    pairs = Counter({("a", "b"): 1, ("a", "c"): 1, ("a", None): 1})
    for w in ("a", "b", "c", None, "zz"):
        known += (pairs["a", w] + s * (c[w] + 1) / (n + v + 1)) / (3 + s)
    assert known == pytest.approx(1) and begin and score and expected == 0


def test_language_model_of_odd_rows(odd, documents):
    rows = lm.report(odd).collect()
    assert len(rows) == 9 and sorted(r["n_tokens"] for r in rows) == [1, 1, 1, 1, 3, 4, 4, 4, 60_001]
    assert lm.report(documents([])).count() == 0
    unknown = lm.report(documents(["a b"], ids=[next(i for i in range(99) if crc(i, 7) == 2)])).collect()
    assert unknown[0]["train_tokens"] == 0 and unknown[0]["base_score"] == 0.0


# ---------------------------------------------------------------- language

SYLLABLES = {"aa": "ka lo mi tu", "bb": "sch ein ung er", "cc": "eau ou çon é", "dd": "th ing ly wh"}


def written(lang, seed, n=30):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_language_held_out(documents):
    langs = [rng for i in range(200) for rng in [list(SYLLABLES)[i % 4]]]
    found = language.report(documents([written(x, i) for i, x in enumerate(langs)], langs=langs)).collect()
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in found)
    wrong = [r for r in found if r["lang_pred"] != langs[r["doc_id"]]]
    assert len(wrong) <= 2 and sum(r["held_out"] for r in found) > 30


def test_language_never_sees_the_label(documents):
    langs = [list(SYLLABLES)[i % 4] for i in range(80)]
    texts = [written(x, i) for i, x in enumerate(langs)]
    found = {r["doc_id"]: r["lang_pred"] for r in language.report(documents(texts, langs=langs)).collect()}
    hidden = [x if crc(i, 4) != 2 else "zz" for i, x in enumerate(langs)]
    assert {r["doc_id"]: r["lang_pred"] for r in language.report(documents(texts, langs=hidden)).collect()} == found


def test_language_of_odd_rows(odd, documents):
    rows = language.report(odd).collect()
    assert Counter(r["lang_pred"] for r in rows) == {"und": 4, "en": 5}
    assert {r["lang_pred"] for r in language.report(documents(["a", "12 .", None], langs=[None] * 3)).collect()} == {"und"}
    assert language.report(documents([])).count() == 0


def test_ambiguous_codewords():
    model = {"langs": ["a", "b"], "codes": language.codewords(2), "useful": language.np.ones(2)}
    best, score = language.decode(language.np.array([[0.0, 0.0], [2.0, -2.0]]), model)
    assert score[0] < language.AMBIGUOUS < score[1] and best[1] == 0


# ---------------------------------------------------------------- toxicity


def test_toxicity_held_out(documents, labels):
    rng = random.Random(3)
    toxic = [i % 5 == 0 for i in range(400)]
    texts = []
    for bad in toxic:
        text = [f"w{rng.randrange(300)}" for _ in range(40)]
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(40), rng.choice(["vilething", "badword", "xslurx"]))
        texts.append(" ".join(text))
    known = labels([(i, 1, int(bad)) for i, bad in enumerate(toxic) if i % 7 != 3])
    found = {r["doc_id"]: r for r in toxicity.report(documents(texts), known).collect()}
    held = [i for i in range(400) if crc(i, 4) == 2]
    assert all(found[i]["held_out"] == (i in held) and found[i]["predicted"] == int(found[i]["score"] >= 0.3) for i in range(400))
    assert sum(found[i]["predicted"] != toxic[i] for i in held) <= 0.03 * len(held)
    # Labels of held-out rows teach nothing.
    turned = labels([(i, 1, int(bad) if crc(i, 4) != 2 else int(not bad)) for i, bad in enumerate(toxic) if i % 7 != 3])
    assert {i: r["score"] for i, r in found.items()} == {r["doc_id"]: r["score"] for r in toxicity.report(documents(texts), turned).collect()}


def test_toxicity_of_odd_rows(odd, documents, labels):
    rows = toxicity.report(odd, labels([(3, 1, 1), (None, 0, 1), (5, 0, None), (0, 0, 0)])).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["predicted"] for r in toxicity.report(odd, labels([])).collect()} == {0}
    assert toxicity.report(documents([]), labels([(1, 0, 1)])).count() == 0


def test_risk_is_held_at_zero():
    """Where the unlabelled rows look like the positives, the clean risk would turn negative; scores stay finite."""
    rows = [toxicity.np.array([i % 3, 5]) for i in range(30)]
    chosen, weights, intercept = toxicity.train(rows, rows, 0.5)
    assert toxicity.np.isfinite([*weights, intercept]).all() and len(chosen) == len(weights)


# ---------------------------------------------------------------- queries and the pipeline


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    found, expected = QUERIES[name](spark, FOLDER), duck.sql(ORACLES[name])
    assert canonical([tuple(r) for r in found.collect()], found.columns) == canonical(expected.fetchall(), expected.columns)


def test_every_operator_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


def test_pipeline_stages(spark):
    """Each stage on the rows of the one before, against what the tested operators say of those rows."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.staged(stage(spark, docs, FOLDER), "test")
        before_ids, after_ids = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (docs, after))
        assert after_ids <= before_ids and after.count() == len(after_ids), name
        if number < 4:
            assert after.columns == columns and after.schema["text"].dataType == docs.schema["text"].dataType
        if number == 0:
            verdicts = {r["doc_id"]: r["kept"] for r in corpus_pipeline.quality.report(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
            assert after_ids == {i for i, kept in verdicts.items() if kept}
        if number == 1:
            whole = {r["doc_id"]: r["text"] for r in docs.collect()}
            cleaned = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup.cleaned(docs, grown=True).collect()}
            assert set(cleaned) == before_ids and after_ids == {i for i, text in cleaned.items() if words(text) or text == whole[i]}
            lines = [x.split() for r in after.select("text").collect() for x in r["text"].split("\n") if x.split()]
            assert len(lines) == len({tuple(x) for x in lines})
            assert all(len(r["text"]) == r["n_chars"] for r in after.collect())
        if number == 2:
            found = corpus_pipeline.minhash.report(docs).collect()
            assert after_ids == {r["component_id"] for r in found}
        if number == 3:
            found = corpus_pipeline.decontaminate.report(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()
            assert after_ids == {r["doc_id"] for r in found if not r["contaminated"]}
        if number == 4:
            assert after_ids == before_ids and all(r["copies"] <= 3 for r in after.collect())
            ran = corpus_pipeline.run(spark, FOLDER)
            assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, after.collect()))
        docs = after
