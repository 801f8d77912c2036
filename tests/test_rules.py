import pytest

from ruleloom.operators import rules as R
from ruleloom.plans.samples import workbook_bytes

SAMPLE = """column,type,operator,value,threshold,priority,weight,options
Item,code,equals,007741,,7,,
Item,fuzzy,similar,橡木书桌,0.7,,1.0,code_prefer=true;normalize=true
Price,number,between,12.25-80,,,,
Shop,text,contains, 木器 ,,4,1.0,ignore_case=true
Tags,fuzzy,similar,Lathe,65%,,1.0,
Contact,regex,match,^\\+?\\d{3}-\\d+$,,,1.0,
Grade,enum,in,甲;乙;丙;丁,,2,,
Note,text,equals,"a ""b"", c",,,,
"""


def test_load_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("﻿" + SAMPLE, encoding="utf-8")
    rules = R.compile_rules(R.load_rules(spark, str(path))).rules
    assert [r.column for r in rules] == ["Item", "Item", "Price", "Shop", "Tags", "Contact", "Grade", "Note"]
    assert rules[0].value == "007741" and rules[0].digits == "007741"
    assert rules[1].threshold == 0.7 and rules[1].normalize and rules[1].code_prefer
    assert (rules[2].low, rules[2].high) == (12.25, 80.0)
    assert rules[3].value == "木器" and rules[3].ignore_case
    assert rules[4].threshold == 0.65
    assert rules[5].value == r"^\+?\d{3}-\d+$"
    assert rules[6].items == ("甲", "乙", "丙", "丁")
    assert rules[7].value == 'a "b", c'
    assert all(r.problem is None and r.weight == 1.0 for r in rules)
    assert rules[1].desc == "Item:fuzzy/similar=橡木书桌"


def test_load_from_workbook(spark, tmp_path):
    rows = [list(R.RULE_COLUMNS), ["Item", "code", "equals", "007741", None, None, 0.5, None]]
    (tmp_path / "rules.xlsx").write_bytes(workbook_bytes({"Sheet1": rows}))
    (rule,) = R.compile_rules(R.load_rules(spark, str(tmp_path / "rules.xlsx"))).rules
    assert (rule.value, rule.weight, rule.threshold) == ("007741", 0.5, 0.0)


def test_missing_column_is_an_error(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("column,type,operator,value\na,text,equals,b\n")
    with pytest.raises(ValueError, match="threshold"):
        R.load_rules(spark, str(path))


def test_diagnostics(spark):
    rules = R.as_rule_set(spark, [
        ("a", "number", "between", "abc"),
        ("a", "number", "min", "x"),
        ("a", "regex", "match", "("),
        ("a", "colour", "is", "red"),
        ("a", "text", "like", "x"),
        ("a", "fuzzy", "similar", "x", "low"),
        ("a", "text", "equals", "x", "", "", "heavy"),
        ("b", "text", "equals", "x"),
        ("a", "regex", "match", "(?P<n>a)(?P=n)"),
    ])
    found = {(r["rule_id"], r["problem"]) for r in rules.diagnostics(spark, columns=["a"]).collect()}
    assert found == {
        (1, "bad range"), (2, "bad number"), (3, "bad pattern"), (4, "unknown type"), (5, "unknown operator"),
        (6, "bad threshold"), (7, "bad weight"), (8, "missing column"),
    }
    assert rules.rules[5].threshold == 0.0 and rules.rules[6].weight == 1.0


def test_by_priority(spark):
    rules = R.rule_frame(spark, [("a", "text", "equals", v, "", p) for v, p in (("x", "10"), ("y", "2"), ("z", "no"))])
    assert [r["value"] for r in R.by_priority(rules).collect()] == ["y", "x", "z"]


def test_rule_limit(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_RULES", 2)
    with pytest.raises(ValueError, match="at most 2"):
        R.as_rule_set(spark, [("a", "text", "equals", str(i)) for i in range(3)])
