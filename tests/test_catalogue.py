"""Every query that has SQL, compared with DuckDB on the smallest tables; the others against plain Python."""

import os
from difflib import SequenceMatcher

import duckdb
import pytest

import __spark_entry__ as entry
import plain
from ruleloom.functions.similarity import token_set_similarity
from ruleloom.operators import match as M
from ruleloom.plans import catalogue as Q
from ruleloom.plans import tables as T

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = entry.queries()[name](spark, FOLDER)
    expected = duck.sql(entry.oracle_sql()[name])
    assert canonical([tuple(r) for r in found.collect()], found.columns) == canonical(expected.fetchall(), expected.columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_fuzzy_sequence(spark):
    for r in Q.fuzzy_sequence(spark, FOLDER).collect():
        first, second = (SequenceMatcher(None, plain.strict(r["major"]), t).ratio() for t in ("smallring", "widgetred"))
        assert r["_match_all"] == (first >= 0.6 or second >= 0.55)
        assert r["_score_all"] == pytest.approx(first * 0.5 + second * 0.25, abs=5.1e-5)


def test_fuzzy_token_set(spark):
    for r in Q.fuzzy_token_set(spark, FOLDER).collect():
        text = " ".join(plain.half(r["major"]).lower().split())
        first, second = (token_set_similarity(text, t) for t in ("small ring", "widget red"))
        assert r["_match_all"] == (first >= 0.6 or second >= 0.55)
        assert r["_score_all"] == pytest.approx(first * 0.5 + second * 0.25, abs=5.1e-5)


def test_screen_rule_table_fuzzy(spark):
    rules = [tuple(r) for r in T.rule_table(spark, FOLDER).collect()]
    for r in Q.screen_rule_table_fuzzy(spark, FOLDER).collect():
        match, total = plain.screen(rules, r.asDict(), "OR")
        assert (r["_match_all"], r["_score_all"]) == (match, pytest.approx(total, abs=5.1e-5))


def test_best_match_full(spark):
    reqs = M.parse_requirements(T.requirement_lines(spark, FOLDER)).orderBy("req_idx").collect()
    listed = [(r["name"], r["code"]) for r in reqs]
    for r in Q.best_match_full(spark, FOLDER).collect():
        found = (r["_match"], r["_matched_name"], r["_matched_code"], r["_score"])
        hit, name, code, score = plain.best(r["major"], listed, 0.6)
        assert found == (hit, name, code, pytest.approx(score, abs=5.1e-5))


def test_sample_pairs(spark):
    pairs = {tuple(r) for r in Q._named_pairs(spark, FOLDER).collect()}
    sample = [tuple(r) for r in Q.sample_pairs(spark, FOLDER).collect()]
    assert len(sample) == 3 and set(sample) <= pairs
