"""Rule tables: reading, checking and typing.

A rule table is a job parameter of at most a few hundred rows. It is parsed by native columns, collected
behind a size check, and from then on only its typed form is used to build expressions over the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions import params as P
from ruleloom.functions import text as X
from ruleloom.schema import DIAGNOSTIC_SCHEMA, RULE_COLUMNS

MAX_RULES = 5000  # rules travel inside expressions; a longer table is refused, not cut (the documented limit for users is 500)

# The rule types and the operators of each.
OPERATORS = {
    "text": ("equals", "contains", "startswith", "endswith"),
    "number": ("between", "min", "max", "equals"),
    "regex": ("match",),
    "fuzzy": ("similar",),
    "enum": ("in",),
    "boolean": ("is",),
    "code": ("equals",),
}


@dataclass(frozen=True)
class Rule:
    rule_id: int
    column: str
    type: str
    operator: str
    value: str
    options: str
    ignore_case: bool
    normalize: bool
    code_prefer: bool
    threshold: float
    weight: float
    number: float | None
    low: float | None
    high: float | None
    truth: bool
    items: tuple[str, ...]
    folded_items: tuple[str, ...]
    folded: str
    strict: str
    spaced: str
    digits: str
    code: str
    problem: str | None = None
    notes: tuple[str, ...] = ()

    @property
    def desc(self) -> str:
        return f"{self.column}:{self.type}/{self.operator}={self.value}"


@dataclass(frozen=True)
class RuleSet:
    """Typed rules in the order of the table. Rules with a problem never hit."""

    rules: tuple[Rule, ...]
    notes: tuple[tuple[int, str], ...] = field(default=())

    def __len__(self) -> int:
        return len(self.rules)

    def diagnostics(self, spark: SparkSession, columns: Sequence[str] | None = None) -> DataFrame:
        """One row per finding; with ``columns`` also the rules whose column the data lack."""
        rows = []
        for r in self.rules:
            findings = [*([r.problem] if r.problem else []), *r.notes]
            if columns is not None and r.column not in columns:
                findings.append("missing column")
            rows += [(r.rule_id, r.column, r.type, r.operator, r.value, f) for f in findings]
        return spark.createDataFrame(rows, DIAGNOSTIC_SCHEMA)


def rule_frame(spark: SparkSession, rows: Iterable[Sequence[str]]) -> DataFrame:
    """Rules written in code: sequences in the order of the rule columns; trailing fields may be left out."""
    padded = [tuple(r) + ("",) * (len(RULE_COLUMNS) - len(r)) for r in rows]
    arrays = [pa.array([r[i] for r in padded], pa.string()) for i in range(len(RULE_COLUMNS))]
    return spark.createDataFrame(pa.table(arrays, names=list(RULE_COLUMNS)))


def clean_rules(df: DataFrame) -> DataFrame:
    """The eight rule columns, trimmed, null as empty text; an absent column is an error."""
    absent = [c for c in RULE_COLUMNS if c not in df.columns]
    if absent:
        raise ValueError(f"the rule table lacks the columns {absent}")
    return df.select(*(X.strip(X.blank_null(F.col(c).cast("string"))).alias(c) for c in RULE_COLUMNS))


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Read a rule table from CSV (or from the first sheet of a workbook) as text."""
    if path.lower().endswith(".xlsx"):
        from ruleloom.sources.workbook import read_workbooks

        return clean_rules(read_workbooks(spark, [path]))
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return clean_rules(raw)


def by_priority(rules: DataFrame) -> DataFrame:
    """Rules ordered for display; the priority has no effect on hits."""
    return rules.orderBy(F.col("priority").try_cast("int").asc_nulls_last(), *RULE_COLUMNS)


def _java_pattern(spark: SparkSession, pattern: str) -> str | None:
    """The pattern in Java syntax with Unicode classes, or None if Java refuses it."""
    named = re.sub(r"\(\?P<", "(?<", pattern)
    named = "(?Ud)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", named)
    try:
        spark._jvm.java.util.regex.Pattern.compile(named)
    except Exception:
        return None
    return named


def _problem(row) -> str | None:
    if row["type"] not in OPERATORS:
        return "unknown type"
    if row["operator"] not in OPERATORS[row["type"]]:
        return "unknown operator"
    if row["type"] == "number":
        if row["operator"] == "between" and (row["low"] is None or row["high"] is None):
            return "bad range"
        if row["operator"] != "between" and row["number"] is None:
            return "bad number"
    return None


def compile_rules(rules: DataFrame, max_rules: int | None = None) -> RuleSet:
    """Check and type a rule table; one of more than ``max_rules`` is an error."""
    most = MAX_RULES if max_rules is None else max_rules
    spark = rules.sparkSession
    value, opts = F.col("value"), F.col("opts")
    typed = clean_rules(rules).withColumn("opts", P.parse_options("options"))
    typed = typed.withColumns(
        {
            "ignore_case": P.option_on(opts, "ignore_case"),
            "normalize": P.option_on(opts, "normalize"),
            "code_prefer": P.option_on(opts, "code_prefer"),
        }
    )

    def folded(c):
        return F.when(F.col("normalize"), X.normalize_strict(c)).when(F.col("ignore_case"), F.lower(c)).otherwise(c)

    typed = typed.select(
        *RULE_COLUMNS,
        "ignore_case",
        "normalize",
        "code_prefer",
        P.parse_fraction("threshold").alias("fraction"),
        P.to_number("weight").alias("factor"),
        P.to_number(value).alias("number"),
        P.parse_range(value)["lo"].alias("low"),
        P.parse_range(value)["hi"].alias("high"),
        P.to_bool(value).alias("truth"),
        P.split_list(value).alias("items"),
        F.transform(P.split_list(value), folded).alias("folded_items"),
        folded(value).alias("folded"),
        X.normalize_strict(value).alias("strict"),
        X.normalize_spaces(value).alias("spaced"),
        X.digits_only(value).alias("digits"),
        X.extract_code(value).alias("code"),
    )
    rows = typed.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a rule table holds at most {most} rules")
    out = []
    for i, row in enumerate(rows, start=1):
        problem, notes = _problem(row), []
        if row["type"] == "fuzzy" and row["fraction"] is None:
            notes.append("bad threshold")
        if row["weight"] and row["factor"] is None:
            notes.append("bad weight")
        rule = Rule(
            rule_id=i,
            threshold=0.0 if row["fraction"] is None else row["fraction"],
            weight=1.0 if row["factor"] is None else row["factor"],
            items=tuple(row["items"]),
            folded_items=tuple(row["folded_items"]),
            problem=problem,
            notes=tuple(notes),
            **{
                k: row[k]
                for k in (
                    "column type operator value options ignore_case normalize code_prefer number low high truth "
                    "folded strict spaced digits code"
                ).split()
            },
        )
        if rule.type == "regex" and problem is None:
            pattern = _java_pattern(spark, rule.value)
            rule = replace(rule, problem="bad pattern") if pattern is None else replace(rule, folded=pattern)
        out.append(rule)
    return RuleSet(tuple(out))


def as_rule_set(spark: SparkSession, rules) -> RuleSet:
    if isinstance(rules, RuleSet):
        return rules
    if isinstance(rules, DataFrame):
        return compile_rules(rules)
    return compile_rules(rule_frame(spark, rules))
