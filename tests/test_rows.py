"""Dedup, unions, positions, limits and pairs, with one source or key that holds most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import dedup as D
from ruleloom.operators import ordering as O
from ruleloom.operators import pairs as B


@pytest.fixture(scope="module")
def skewed(spark):
    """Three sources, one of them null and one with most of the rows; row numbers have gaps."""
    rng = random.Random(2)
    rows = []
    for source, n in (("big", 700), ("small", 60), (None, 40)):
        for i in sorted(rng.sample(range(0, 5000), n)):
            rows.append((source, i, rng.choice(["k1", "k1", "k2", "k3", None])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "src string, idx long, key string").repartition(5).cache()


def test_keep_first(skewed):
    rows = [tuple(r) for r in skewed.collect()]
    found = {r["key"]: (r["src"], r["idx"]) for r in D.dedup(skewed, ["idx", "src"], key="key").collect()}
    for key in ("k1", "k2", "k3", None):
        first = min(((i, s) for s, i, k in rows if k == key), key=lambda t: (t[0], t[1] or ""))
        assert found[key] == (first[1], first[0])
    assert len(found) == 4


def test_hot_key_is_cut_before_the_shuffle(skewed):
    plan = D.dedup(skewed, ["idx"], key="key")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_dedup_is_idempotent(skewed):
    once = D.dedup(skewed, ["idx", "src"], key="key")
    assert sorted(map(str, D.dedup(once, ["idx", "src"], key="key").collect())) == sorted(map(str, once.collect()))


def test_fallback_key(spark):
    rows = [(0, "信息 管理", "1201"), (1, "信息管理!", "1201"), (2, "信息管理", "1202"), (3, None, None), (4, "", "")]
    df = spark.createDataFrame(rows, "i int, Major string, _matched_code string")
    assert [r["i"] for r in D.dedup(df, ["i"], key="PersonID", column="Major").orderBy("i").collect()] == [0, 2, 3]
    assert [r["i"] for r in D.dedup(df.drop("_matched_code"), ["i"], column="Major").orderBy("i").collect()] == [0, 3]


def test_no_dedup_column_is_an_error(skewed):
    with pytest.raises(ValueError, match="no column"):
        D.dedup(skewed, ["idx"], key="PersonID", column="Major")


def test_append_old_rows_win(spark):
    old = spark.createDataFrame([("a", 5, "old"), ("a", 9, "old"), ("b", 7, "old")], "k string, i int, note string")
    new = spark.createDataFrame([("a", 1, 1.0), ("c", 2, 2.0), ("c", 1, 3.0)], "k string, i int, extra double")
    found = sorted(map(tuple, D.append(old, new, ["i"], key="k").collect()))
    assert found == [("a", 5, "old", None), ("b", 7, "old", None), ("c", 1, None, 3.0)]


def test_positions_per_source(skewed):
    found = O.with_position(skewed, ["idx"], group=["src"]).collect()
    assert len(found) == 800
    for source in ("big", "small", None):
        mine = sorted((r["idx"], r["_position"]) for r in found if r["src"] == source)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1))


def test_positions_over_all(skewed):
    found = sorted((r["_position"], r["src"] or "", r["idx"]) for r in O.with_position(skewed, ["src", "idx"]).collect())
    assert [p for p, _, _ in found] == list(range(1, 801))
    assert [(s, i) for _, s, i in found] == sorted((s, i) for _, s, i in found)


@pytest.mark.parametrize("window_limit", [0, 1000])
def test_null_index_is_a_row(spark, monkeypatch, window_limit):
    monkeypatch.setattr(O, "WINDOW_LIMIT", window_limit)
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), (None, 3, 3)], "src string, idx long, v int")
    assert sorted(r["v"] for r in O.limit_per_source(df, 5, ["src"], "idx").collect()) == [1, 2, 3]
    assert sorted(r["v"] for r in O.limit_per_source(df, 1, ["src"], "idx").collect()) == [1, 3]
    assert sorted((r["_position"], r["v"]) for r in O.with_position(df, ["idx"], ["src"]).collect()) == [(1, 1), (1, 3), (2, 2)]


@pytest.mark.parametrize("n", [1, 50, 500])
@pytest.mark.parametrize("window_limit", [0, 1000])
def test_limit_per_source(skewed, monkeypatch, n, window_limit):
    monkeypatch.setattr(O, "WINDOW_LIMIT", window_limit)
    found = O.limit_per_source(skewed, n, ["src"], "idx").collect()
    rows = [(r["src"], r["idx"]) for r in skewed.collect()]
    for source in ("big", "small", None):
        expected = sorted(i for s, i in rows if s == source)[:n]
        assert sorted(r["idx"] for r in found if r["src"] == source) == expected


def test_read_order(skewed):
    found = [(r["src"] or "", r["idx"]) for r in O.in_read_order(skewed, ["src", "idx"]).collect()]
    assert found == sorted(found)


def plain_pairs(lines):
    """Each line without Chinese, with the Chinese lines since the last such line; none if there are no Chinese ones."""
    told = [(i, t.strip(), any("一" <= c <= "鿿" for c in t)) for i, t in lines if t.strip()]
    others = [k for k, (_, _, chinese) in enumerate(told) if not chinese]
    spans = zip([-1, *others], others)
    return [(told[b][0], "".join(t for _, t, _ in told[a + 1 : b]), told[b][1]) for a, b in spans if b > a + 1]


EDGE = ["first is English", "你好", "世界 ", "", " hello world", "second English", "1.", "再见", "bye", "末尾"]


@pytest.mark.parametrize("block", [1, 3, 1 << 17])
def test_pair_lines(spark, block):
    rng = random.Random(6)
    files = {"edge": list(enumerate(EDGE)), None: [(7, "中"), (9, "x")]}
    for name, n in (("big", 400), ("mid", 30)):
        files[name] = [(i * 3, rng.choice(["中文%d", "汉%d", "", "en %d", "  "]) .replace("%d", str(i))) for i in range(n)]
    rows = [(f, i, t) for f, ls in files.items() for i, t in ls]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "f string, i long, line string")
    found = B.pair_lines(df, ["f"], "i", block_rows=block).collect()
    for name, lines in files.items():
        mine = sorted((r["pair_idx"], r["zh"], r["en"]) for r in found if r["f"] == name)
        assert mine == plain_pairs(lines)


def test_skip_numbering(spark):
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(["你好", "1.", "hello", "再", "2)", "3、", "bye"])], "f string, i long, line string")
    found = B.pair_lines(df, ["f"], "i", skip_numbering=True).orderBy("pair_idx").collect()
    assert [(r["zh"], r["en"]) for r in found] == [("你好", "hello"), ("再", "bye")]


def test_complete_and_sample(spark):
    df = spark.createDataFrame([("a", "中", "x"), ("a", "", "y"), ("b", "文", None), ("b", "字", "z")], "dataset string, zh string, en string")
    assert [r["zh"] for r in B.complete_pairs(df).collect()] == ["中", "字"]
    assert B.dataset_named(df, "none").count() == 0
    many = spark.range(100).select(F.col("id").cast("string").alias("zh"))
    sample = [r["zh"] for r in B.sample_pairs(many, 3, seed=1).collect()]
    assert len(set(sample)) == 3 and sample == [r["zh"] for r in B.sample_pairs(many, 3, seed=1).collect()]
