import random

import pytest
from pyspark.sql import functions as F

import plain
from ruleloom.functions.similarity import token_set_similarity
from ruleloom.operators import screen as S
from ruleloom.operators.rules import as_rule_set

COLUMNS = ["Tag", "Part", "Notes", "Maker", "Price", "Contact", "Grade", "Stocked"]
PARTS = [
    ("1", "oak table (440871)", "CNC cut, Lacquer", "Nordic Works", "12.5", "+49-301", "A", "yes"),
    ("2", "oak table 440871", "sander", "some shed", " 12.5 ", "none", "B", "no"),
    ("3", "glazed tile551208XY", None, "NORDIC atelier", "NaN", "031-77", "C ", "1"),
    ("4", "４４０８７１", "cnc CUT", None, "2.5f", None, "Prime", None),
    ("5", "12345678", "lathe 手工 木", "works", "2d", "", "prime", "TRUE"),
    ("6", None, "", "", "inf", "x y-z", None, ""),
    ("7", "oak　 table", "kiln", "wrks", "12.25", "7-1", "A", "t"),
    ("8", "table oak", "wheel;CNC", "wor ks", "-3", "99-12\n", "", "false"),
    ("9", "nan", "None", "x", "15", "-", "A", "y"),
]
RULES = [
    ("Notes", "text", "contains", "cnc", "", "4", "0.75", "ignore_case=true"),
    ("Part", "code", "equals", "440871", "", "9", "0.5"),
    ("Price", "number", "between", "12.2-14", "", "", "1.5"),
    ("Part", "fuzzy", "similar", "oak table", "72%", "1", "1.3", "code_prefer=true;normalize=true"),
    ("Grade", "enum", "in", "A;C;PRIME;F", "", "", "0.125", "ignore_case=true"),
    ("Part", "fuzzy", "similar", "glazed tile (551208)", "60%", "", "0.25", "code_prefer=true"),
    ("Notes", "text", "contains", "kiln", "", "", "9", "ignore_case=true"),
    ("Notes", "text", "contains", "sander", "", "", "2", ""),
    ("Contact", "regex", "match", r"^\+?\d+-\d+$"),
    ("Maker", "text", "contains", "orks", "", "", "0.1"),
    ("Grade", "text", "equals", "A", "", "", "2"),
    ("Stocked", "boolean", "is", "true", "", "", "x"),
    ("Stocked", "boolean", "is", "no"),
    ("Price", "number", "min", "12.3"),
    ("Price", "number", "max", "0"),
    ("Price", "number", "equals", "12.25"),
    ("Price", "number", "between", "-10-0"),
    ("Price", "number", "between", "abc"),
    ("Maker", "text", "startswith", "nordic", "", "", "", "ignore_case=true"),
    ("Maker", "text", "endswith", "wor ks", "", "", "", "normalize=true"),
    ("Maker", "text", "equals", ""),
    ("Contact", "regex", "match", "("),
    ("Absent", "boolean", "is", "false"),
    ("Part", "code", "equals", "123456", "", "", "4"),
    ("Part", "code", "equals", "", "", "", "8"),
    ("Part", "colour", "equals", "x"),
]


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame(PARTS, ", ".join(f"{c} string" for c in COLUMNS)).cache()


def rows_of(df):
    return {r["Tag"]: (r["_match_all"], r["_score_all"]) for r in df.collect()}


def expected(rules, mode, threshold=0.8):
    out = {}
    for part in PARTS:
        match, total = plain.screen(rules, dict(zip(COLUMNS, part)), mode, threshold)
        out[part[0]] = (match, pytest.approx(total, abs=5.1e-5))
    return out


@pytest.mark.parametrize("mode", S.MODES)
def test_all_rules_against_plain(parts, mode):
    assert rows_of(S.screen(parts, RULES, mode=mode, threshold=3.0)) == expected(RULES, mode, 3.0)


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r[1]}-{r[2]}-{r[3]}")
def test_each_rule_alone(parts, rule):
    if rule[1] == "fuzzy":
        found = rows_of(S.screen(parts, [rule], audit=True))
    else:
        found = rows_of(S.screen(parts, [rule]))
    assert found == expected([rule], "OR")


@pytest.mark.parametrize("mode", S.MODES)
@pytest.mark.parametrize("similarity", S.SIMILARITIES)
def test_hits_only_equals_filter(parts, mode, similarity):
    rules = RULES[:2] + RULES[4:6]
    whole = S.keep_hits(S.screen(parts, rules, mode=mode, threshold=1.2, similarity=similarity))
    direct = S.screen(parts, rules, mode=mode, threshold=1.2, similarity=similarity, hits_only=True)
    assert rows_of(direct) == rows_of(whole)


def test_and_within_or_and_weighted(parts):
    rules = [r[:6] for r in RULES if r[1] != "fuzzy" and r[1] != "boolean"][:5]
    hits = {m: {k for k, v in rows_of(S.screen(parts, rules, mode=m, threshold=1e-9)).items() if v[0]} for m in S.MODES}
    assert hits["AND"] <= hits["OR"] == hits["WEIGHTED"]


def test_audit_forms_agree(parts):
    wide = S.screen(parts, RULES, audit=True)
    n = sum(c.startswith("_cond_") for c in wide.columns) // 3
    assert n == len(RULES) - 1  # two keywords with equal options share one entry
    fields = [f"{i}, _cond_{i}_match, _cond_{i}_score, _cond_{i}_desc" for i in range(1, n + 1)]
    stacked = wide.selectExpr("Tag", f"stack({n}, {', '.join(fields)}) as (rule_id, hit, score, desc)")
    long = S.audit_long(parts, RULES, ["Tag"])
    assert sorted(map(tuple, stacked.collect())) == sorted(map(tuple, long.collect()))
    assert rows_of(wide) == rows_of(S.screen(parts, RULES))
    assert "Notes:contains_any(2)" in {r["desc"] for r in long.collect()}


@pytest.mark.parametrize("mode", S.MODES)
def test_long_form_equals_single_pass(parts, mode):
    n = len(RULES) - 1
    hits = S.hits_long(parts, RULES, ["Tag"])
    folded = S.fold_hits(hits, ["Tag"], n, mode, threshold=3.0)
    expected = rows_of(S.screen(parts, RULES, mode=mode, threshold=3.0))
    assert rows_of(folded) == expected
    assert rows_of(S.fold_rows(parts, RULES, ["Tag"], mode, threshold=3.0)) == expected


def test_row_fold_shuffles_nothing(parts):
    plan = S.fold_rows(parts, RULES, ["Tag"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
    twice = S.fold_rows(parts.unionAll(parts), RULES, ["Tag"])  # repeated keys stay rows of their own
    assert twice.count() == 2 * parts.count()


def test_keywords_ungrouped(parts):
    rules = [RULES[0], RULES[6]]
    found = rows_of(S.screen(parts, rules, group_contains=False))
    assert found["1"] == (True, 0.75) and found["7"] == (True, 9.0)
    assert rows_of(S.screen(parts, rules))["7"] == (True, 0.75)


def test_normalised_keywords(parts):
    rules = [("Maker", "text", "contains", w, "", "", "", "normalize=true") for w in ("wor ks", "ＮＯＲＤＩＣ", "!!")]
    assert {k for k, v in rows_of(S.screen(parts, rules)).items() if v[0]} == {"1", "3", "5", "8"}


def test_weighted_compares_the_unrounded_total(parts):
    rules = [("Tag", "text", "equals", "1", "", "", "0.79996")]
    assert rows_of(S.screen(parts, rules, mode="WEIGHTED", threshold="80%"))["1"] == (False, 0.8)
    assert rows_of(S.screen(parts, rules, mode="WEIGHTED", threshold=0.79996))["1"] == (True, 0.8)


def test_scores_are_added_in_rule_order(spark):
    """Set rules of one column stand apart in the table; added up as a group they would miss the threshold."""
    df = spark.createDataFrame([("x", 5)], "a string, b int")
    rules = [("a", "text", "equals", "x", "", "", "0.1"), ("b", "number", "min", "1", "", "", "0.1"), ("a", "text", "equals", "x", "", "", "0.6")]
    assert (0.1 + 0.1) + 0.6 >= 0.8 > (0.1 + 0.6) + 0.1
    found = S.screen(df, rules, mode="WEIGHTED", threshold=0.8)
    assert [tuple(r)[2:] for r in found.collect()] == [(True, 0.8)]
    assert S.screen(df, rules, mode="WEIGHTED", threshold=0.8, hits_only=True).count() == 1
    folded = S.fold_hits(S.hits_long(df, rules, ["b"]), ["b"], 3, "WEIGHTED", 0.8)
    assert [tuple(r)[1:] for r in folded.collect()] == [(True, 0.8)]
    assert [tuple(r)[1:] for r in S.fold_rows(df, rules, ["b"], "WEIGHTED", 0.8).collect()] == [(True, 0.8)]


def test_settings_are_checked(parts):
    with pytest.raises(ValueError, match="mode"):
        S.screen(parts, [], mode="XOR")
    with pytest.raises(ValueError, match="similarity"):
        S.screen(parts, [], similarity="soundex")


@pytest.mark.parametrize("n", [3, 64, 65, 300])
@pytest.mark.parametrize("mode", S.MODES)
def test_many_keywords(parts, n, mode):
    words = [f"No{i}x" for i in range(n - 2)] + ["CNC cut", "(x|"]
    rules = [("Notes", "text", "contains", w, "", "", "", "ignore_case=true") for w in words]
    rules += [("Price", "number", "min", "3"), ("Notes", "text", "contains", "Lacq")]
    assert rows_of(S.screen(parts, rules, mode=mode)) == expected(rules, mode)
    whole = S.keep_hits(S.screen(parts, rules, mode=mode))
    assert rows_of(S.screen(parts, rules, mode=mode, hits_only=True)) == rows_of(whole)


def test_token_set_scores(parts):
    rule = ("Notes", "fuzzy", "similar", "Lacquer CNC cut,", "0.5")
    found = rows_of(S.screen(parts, [rule], similarity="token_set"))
    assert found["1"] == (True, 1.0)
    assert found["5"][1] == round(token_set_similarity("lathe 手工 木", "lacquer cnc cut,"), 4)


def test_skip_invalid(parts):
    rules = [("Price", "number", "min", "0"), ("Price", "number", "max", "abc")]
    hits = {k for k, v in rows_of(S.screen(parts, rules, mode="AND", on_invalid="skip")).items() if v[0]}
    assert hits == {"1", "2", "6", "7", "9"}
    assert not any(v[0] for v in rows_of(S.screen(parts, rules, mode="AND")).values())


def test_no_rules(parts):
    assert not any(v[0] for v in rows_of(S.screen(parts, [], mode="OR")).values())
    assert all(v[0] for v in rows_of(S.screen(parts, [], mode="AND")).values())


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, 2.5, True), (20, float("nan"), False), (None, None, None)], "a int, b double, c boolean")
    rules = [("b", "number", "min", "1"), ("a", "number", "between", "10-30"), ("c", "boolean", "is", "true"), ("a", "text", "equals", "20")]
    for rule, hits in zip(rules, [[True, False, False], [False, True, False], [True, False, False], [False, True, False]]):
        assert [r["_match_all"] for r in S.screen(df, [rule]).collect()] == hits


def test_bounds_in_the_type_of_the_column(spark, tmp_path):
    from decimal import Decimal

    big = 2**53
    df = spark.createDataFrame([(big + 1, Decimal("1.25")), (-5, Decimal("-1.20")), (None, None)], "a long, b decimal(10,2)")
    for rule, hits in [
        (("a", "number", "equals", str(big)), []), (("a", "number", "equals", f"{big + 1}.0"), [big + 1]), (("a", "number", "max", "-4.5"), [-5]),
        (("a", "number", "min", "-4.5"), [big + 1]), (("a", "number", "equals", "-4.5"), []), (("a", "number", "min", "1e30"), []),
        (("a", "number", "max", "1e30"), [-5, big + 1]), (("a", "number", "min", "-inf"), [-5, big + 1]), (("a", "number", "between", "-5.5--4.5"), [-5]),
        (("b", "number", "equals", "1.250"), [big + 1]), (("b", "number", "min", "1.251"), []), (("b", "number", "max", "1.251"), [-5, big + 1]),
    ]:
        assert sorted(r["a"] for r in S.screen(df, [rule], hits_only=True).collect()) == hits, rule
    df.write.parquet(str(tmp_path / "t"))
    for rule, test in ((("a", "number", "min", "3.5"), "GreaterThanOrEqual(a,4)"), (("b", "number", "max", "7"), "LessThanOrEqual(b,7.00)")):
        plan = S.screen(spark.read.parquet(str(tmp_path / "t")), [rule], hits_only=True)._jdf.queryExecution().executedPlan().toString()
        assert test in plan


def test_odd_column_names(spark):
    df = spark.createDataFrame([("x",), ("y",)], ["a.b `c"])
    assert S.screen(df, [("a.b `c", "text", "equals", "x")], hits_only=True).count() == 1


def test_partitioning_does_not_matter(parts):
    whole = rows_of(S.screen(parts, RULES, mode="WEIGHTED"))
    for n in (1, 3, 16):
        assert rows_of(S.screen(parts.repartition(n), RULES, mode="WEIGHTED")) == whole


def test_bound_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).selectExpr("id", "cast(id as double) as x", "cast(id as string) as s").write.parquet(path)
    rules = [("x", "number", "min", "990"), ("s", "fuzzy", "similar", "995", "0.9")]
    found = S.screen(spark.read.parquet(path), rules, mode="AND", hits_only=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,990.0)" in plan
    assert plan.index("ArrowEvalPython") < plan.index("FileScan")
    assert [r["id"] for r in found.collect()] == [995]


def test_text_is_folded_once(parts):
    """The filter stays above the folded column; bare comparisons still go below it."""
    words = [("Notes", "text", "contains", w, "", "", "", "ignore_case=true") for w in ("a", "b", "c", "d")]
    plan = S.screen(parts, words, hits_only=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(Notes") == 1
    rules = [*words, ("Maker", "text", "equals", "x")]
    plan = S.screen(parts, rules, mode="AND", hits_only=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(Notes") == 1
    assert plan.index("lower(Notes") < plan.rindex("= x")


def test_similarity_runs_once_per_plan(parts):
    plan = S.screen(parts, RULES, hits_only=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_five_hundred_rules(spark):
    rng = random.Random(8)
    rules = []
    for i in range(100):
        rules.append(("v", "fuzzy", "similar", f"name {rng.randint(0, 999)}", "0.8", "", "0.7", "code_prefer=true"))
        rules.append(("v", "code", "equals", f"{i * 7919:06d}"))
        rules.append(("v", "text", "contains", f"word{i}", "", "", "", "ignore_case=true"))
        rules.append(("n", "number", "equals", str(i)))
        rules.append(("v", "regex", "match", f"x{i}$"))
    df = spark.range(2000).selectExpr("id", "concat('name ', id, ' ', lpad(id * 7919, 6, '0')) as v", "id as n")
    found = S.screen(df, rules, mode="OR")
    rows = {r["id"]: r for r in found.select("id", "v", "_match_all", "_score_all").collect()}
    for i in (0, 5, 99, 100, 1500):
        match, total = plain.screen(rules, {"v": rows[i]["v"], "n": str(i)}, "OR")
        assert rows[i]["_match_all"] == match
        assert rows[i]["_score_all"] == pytest.approx(total, abs=5.1e-5)


def test_hits_per_source(parts):
    screened = S.screen(parts.withColumn("src", F.col("Tag").cast("int") % 2), [("Price", "number", "min", "12.3")])
    found = {r["src"]: (r["rows"], r["hits"]) for r in S.hits_per_source(screened, ["src"]).collect()}
    assert found == {0: (4, 2), 1: (5, 2), None: (9, 4)}


def test_rule_set_is_reusable(spark, parts):
    rules = as_rule_set(spark, RULES)
    assert len(rules) == len(RULES)
    assert rows_of(S.screen(parts, rules)) == rows_of(S.screen(parts.select(*reversed(COLUMNS)), rules))
