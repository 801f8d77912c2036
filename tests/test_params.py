import math

import numpy as np

from pyspark.sql import functions as F

from ruleloom.functions import params as P


def test_to_number(evaluate):
    given = ["3.50", " 3.6 ", "1e3", "+.5", "-2.", "NaN", "1.5f", "2d", "abc", "", None, "1 2", "0x10"]
    assert evaluate(P.to_number, given) == [3.5, 3.6, 1000.0, 0.5, -2.0] + [None] * 8
    assert evaluate(P.to_number, ["inf", "-Infinity"]) == [math.inf, -math.inf]


def test_parse_fraction(evaluate):
    assert evaluate(P.parse_fraction, ["85%", "0.85", " 50 % ", "", None, "x", "x%", "85"]) == [
        0.85, 0.85, 0.5, 0.0, 0.0, None, None, 85.0,
    ]


def test_parse_threshold(evaluate):
    assert evaluate(P.parse_threshold, ["80%", "80", "0.8", "1", "250", "-3", "x", ""]) == [
        0.8, 0.8, 0.8, 1.0, 1.0, 0.0, None, None,
    ]


def test_parse_range(evaluate):
    given = ["3.5-4.0", " 1 - 2 ", "-5-10", "-5--1", "1-2-3", "1e2-2e3", "abc", "5", "-5", ""]
    found = [(r["lo"], r["hi"]) for r in evaluate(P.parse_range, given)]
    none = (None, None)
    assert found == [(3.5, 4.0), (1, 2), (-5, 10), (-5, -1), (1, 2), (100, 2000), none, none, none, none]


def test_to_bool(evaluate):
    given = ["true", "YES", "1", "y", "T", "false", "0", "", None, "on"]
    assert evaluate(P.to_bool, given) == [True] * 5 + [False] * 5


def test_split_list(evaluate):
    assert evaluate(P.split_list, ["本科; 硕士 ;;博士;", "", None, "a"]) == [["本科", "硕士", "博士"], [], [], ["a"]]


def test_parse_options(evaluate):
    given = ["ignore_case=true;normalize=true", "flag; k = a=b ;;", "k=1;k=2;k", "", None, "=x"]
    assert evaluate(P.parse_options, given) == [
        {"ignore_case": "true", "normalize": "true"},
        {"flag": "true", "k": "a=b"},
        {"k": "true"},
        {},
        {},
        {"": "x"},
    ]


def test_option_on(evaluate):
    on = lambda c: P.option_on(P.parse_options(F.col(c)), "a")
    assert evaluate(on, ["a", "a=TRUE", "a=false", "b"]) == [True, True, False, False]


def test_round4_is_half_even(spark):
    values = [0.12345, 0.12355, 0.1, 2 / 3, 1103.49825, -0.00005, 0.0] + [i / 32 / 1000 for i in range(2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    found = [r["y"] for r in df.select("i", P.round4("x").alias("y")).orderBy("i").collect()]
    assert found[:4] == [0.1234, 0.1236, 0.1, 0.6667]
    assert found == np.round(np.array(values), 4).tolist()
