"""Screening: a rule set evaluated over a table as one projection, folded by AND, OR or WEIGHTED.

All rules become column expressions of a single pass; no rule causes a shuffle. Rules that ask "is the value one
of these" (text equality, enum, code) are grouped per column into one set test, keyword rules into one search,
fuzzy rules into one UDF call, so the plan grows with the groups and not with the rules.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Context, Decimal, localcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.functions import params as P
from ruleloom.functions import text as X
from ruleloom.functions.similarity import fuzzy_fold, fuzzy_scores
from ruleloom.operators.rules import Rule, RuleSet, as_rule_set
from ruleloom.schema import quoted

MODES = ("AND", "OR", "WEIGHTED")
SIMILARITIES = ("sequence", "token_set", "contains")
CHAINED_SUM = 100  # longer sums are written as one array fold, to keep expression trees shallow
WORDS = 64  # keywords tested in one projected column; more of them stand in further columns
BROADCAST_BYTES = 32 << 20  # values of set rules up to which they are broadcast
SLACK = 1e-9  # rounding allowance where a bound decides which rows need no similarity
WHOLE = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}  # bits
MATCH, SCORE = "_match_all", "_score_all"


@dataclass
class Entry:
    """What the audit shows of one rule, or of one keyword group."""

    rule_id: int
    hit: Column
    score: Column
    desc: str
    weight: float = 1.0


@dataclass
class Term:
    """A group of rules: hit by any, hit by all, weighted score, and the entries in between."""

    any: Column
    all: Column
    total: Column
    entries: list[Entry]
    most: float = 0.0  # upper bound of the total
    costly: bool = False  # needs a UDF
    plain: bool = False  # needs neither a UDF nor a derived column, so it may reach the scan
    lookup: tuple[Column, dict[str, list[Entry]]] | None = None


def _tree(op: Callable, columns: Sequence[Column]) -> Column:
    """Fold columns pairwise, so that the expression stays shallow."""
    columns = list(columns)
    while len(columns) > 1:
        columns = [op(*columns[i : i + 2]) if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    return columns[0]


def any_of(columns: Sequence[Column]) -> Column:
    return _tree(operator.or_, columns) if columns else F.lit(False)


def all_of(columns: Sequence[Column]) -> Column:
    return _tree(operator.and_, columns) if columns else F.lit(True)


def in_order_sum(columns: Sequence[Column]) -> Column:
    """Sum from left to right, so that doubles add up the same way on every run."""
    if not columns:
        return F.lit(0.0)
    if len(columns) > CHAINED_SUM:
        return F.aggregate(F.array(*columns), F.lit(0.0), lambda a, x: a + x)
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


class Features:
    """Derived columns (folded text, code, number), projected once and shared by all rules that use them."""

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.made: dict[tuple[str, str], tuple[str, Column]] = {}
        self.asked = 0  # how often any of them was asked for

    def raw(self, column: str) -> Column:
        return F.col(quoted(column))

    def text(self, column: str) -> Column:
        c = self.raw(column)
        return c if isinstance(self.types[column], T.StringType) else c.cast("string")

    def get(self, column: str, kind: str) -> Column:
        if kind == "text":
            return self.text(column)
        if (column, kind) not in self.made:
            text = self.text(column)
            expr = {
                "lower": F.lower,
                "strict": X.normalize_strict,
                "spaced": X.normalize_spaces,
                "code": X.extract_code,
                "number": P.to_number,
            }[kind](text)
            self.made[column, kind] = (f"__f{len(self.made)}", expr)
        self.asked += 1
        return F.col(self.made[column, kind][0])

    def project(self, df: DataFrame) -> DataFrame:
        if not self.made:
            return df
        return df.select("*", *(e.alias(name) for name, e in self.made.values()), F.spark_partition_id().alias("__once"))

    def settled(self, condition: Column) -> Column:
        """The condition tied to the projection of the derived columns.

        A filter that moves below them would derive each column anew wherever it is used, once per keyword say.
        The partition number, of no effect on the result, is what the optimizer does not move a filter past.
        """
        return condition & (F.col("__once") >= 0) if self.made else condition


def _fold_kind(rule: Rule) -> str:
    return "strict" if rule.normalize else "lower" if rule.ignore_case else "text"


def _exact_bounds(rule: Rule) -> tuple[Decimal | None, Decimal | None]:
    """The bounds of a number rule as written, not as doubles; None where a side is open."""
    if rule.operator == "between":
        low, high = re.match(P.RANGE_TEXT, rule.value.replace(" ", "")).groups()
        return Decimal(low), Decimal(high)
    bound = Decimal(rule.value.strip())
    return None if rule.operator == "max" else bound, None if rule.operator == "min" else bound


def _typed_hit(c: Column, kind: T.DataType, low: Decimal | None, high: Decimal | None) -> Column:
    """low <= c <= high in the column's own type, each bound moved to the nearest value that the type has inside."""
    digits, scale = (kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else (WHOLE[type(kind)], 0)
    most = Decimal(10**digits - 1).scaleb(-scale) if isinstance(kind, T.DecimalType) else Decimal(2 ** (digits - 1) - 1)
    least = -most if isinstance(kind, T.DecimalType) else -most - 1
    step = Decimal(1).scaleb(-scale)
    tests = [c.isNotNull()]
    with localcontext(Context(prec=400)):
        for bound, rounding, op in ((low, ROUND_CEILING, operator.ge), (high, ROUND_FLOOR, operator.le)):
            if bound is None:
                continue
            if bound > most if op is operator.ge else bound < least:
                return F.lit(False)
            if least < bound < most:
                inside = bound.quantize(step, rounding=rounding)
                tests.append(op(c, F.lit(format(inside, "f")).cast(kind)))
    return all_of(tests)


def _number_hit(rule: Rule, features: Features) -> Column:
    """Typed columns are compared as stored, so that the bound can reach the file scan."""
    kind = features.types[rule.column]
    if isinstance(kind, (*WHOLE, T.DecimalType)):
        return _typed_hit(features.raw(rule.column), kind, *_exact_bounds(rule))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = features.raw(rule.column)
        low_guard = ~F.isnan(c)  # NaN would count as the largest number
    else:
        c, low_guard = features.get(rule.column, "number"), None
    if rule.operator == "between":
        return (c >= rule.low) & (c <= rule.high)
    if rule.operator == "min":
        hit = c >= rule.number
        return hit if low_guard is None else hit & low_guard
    if rule.operator == "max":
        return c <= rule.number
    return c == rule.number


def _single_hit(rule: Rule, features: Features) -> Column:
    """The predicate of one rule that no group takes; null means no hit."""
    if rule.type == "number":
        return _number_hit(rule, features)
    if rule.type == "boolean":
        return P.to_bool(features.text(rule.column)) == F.lit(rule.truth)
    if rule.type == "regex":
        return X.blank_null(features.text(rule.column)).rlike(rule.folded)
    c = features.get(rule.column, _fold_kind(rule))
    if rule.folded == "":  # empty text starts and ends any text, also a null one
        return F.lit(rule.operator != "contains")
    return {"startswith": c.startswith, "endswith": c.endswith, "contains": c.contains}[rule.operator](F.lit(rule.folded))


def _single_term(rule: Rule, hit: Column, desc: str | None = None) -> Term:
    score = F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))
    total = F.when(hit, F.lit(rule.weight)).otherwise(F.lit(0.0))
    entry = Entry(rule.rule_id, hit, score, desc or rule.desc, rule.weight)
    return Term(hit, hit, total, [entry], max(rule.weight, 0.0))


def _keyword_term(rules: list[Rule], features: Features, steps: dict[str, Column]) -> Term:
    """Any keyword of a (column, options) group; it counts once, with the weight of its first rule.

    Each keyword is a native test. A long list is cut into projected columns, so that no expression grows with it.
    """
    first = rules[0]
    words = list(dict.fromkeys(r.folded for r in rules if r.folded))
    distinct = len({r.value for r in rules})
    long_list = len(words) > WORDS
    if not words:
        hit = F.lit(False)
    elif len(words) == 1:
        hit = _single_hit(next(r for r in rules if r.folded), features)
    else:
        text = features.get(first.column, _fold_kind(first))
        tests = [any_of([F.contains(text, F.lit(w)) for w in words[i : i + WORDS]]) for i in range(0, len(words), WORDS)]
        if long_list:
            names = [f"__k{len(steps) + i}" for i in range(len(tests))]
            steps.update(zip(names, tests))
            tests = [F.col(n) for n in names]
        hit = any_of(tests)
    term = _single_term(first, hit, f"{first.column}:contains_any({distinct})")
    term.costly = long_list
    return term


def _lookup_keys(rule: Rule) -> list[str]:
    if rule.type == "enum":
        return [x for x in dict.fromkeys(rule.folded_items) if x]
    if rule.type == "code":
        return [rule.digits] if rule.digits else []
    return [rule.folded]


def _is_lookup(rule: Rule) -> bool:
    return rule.type in ("enum", "code") or (rule.type, rule.operator) == ("text", "equals")


def _lookup_term(rules: list[Rule], features: Features, audit: bool) -> Term:
    """Rules that compare one (folded) column with sets of values; entries only for an audit."""
    first = rules[0]
    value = features.get(first.column, "code" if first.type == "code" else _fold_kind(first))
    if any("" in _lookup_keys(r) for r in rules):
        value = X.blank_null(value)

    def is_in(keys) -> Column:
        return value.isin(*keys) if keys else F.lit(False)

    weights: dict[str, float] = {}
    by_key: dict[str, list[Entry]] = {}
    entries = []
    for r in rules:
        for k in _lookup_keys(r):
            weights[k] = weights.get(k, 0.0) + r.weight
        if audit:
            hit = is_in(_lookup_keys(r))
            entry = Entry(r.rule_id, hit, F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0)), r.desc, r.weight)
            entries.append(entry)
            for k in _lookup_keys(r):
                by_key.setdefault(k, []).append(entry)
    common = set.intersection(*(set(_lookup_keys(r)) for r in rules))
    by_weight: dict[float, list[str]] = {}
    for k, w in weights.items():
        by_weight.setdefault(w, []).append(k)
    total = F.lit(0.0)
    if by_weight:  # one set test per distinct sum of weights
        (w, keys), *rest = by_weight.items()
        total = F.when(is_in(keys), F.lit(w))
        for w, keys in rest:
            total = total.when(is_in(keys), F.lit(w))
        total = total.otherwise(F.lit(0.0))
    most = sum(max(r.weight, 0.0) for r in rules)
    return Term(is_in(weights), is_in(common), total, entries, most, lookup=(value, by_key))


def _fuzzy_entry(rule: Rule, similarity: Column, code: Column | None) -> Entry:
    hit = similarity >= rule.threshold
    score = similarity
    if rule.code_prefer and rule.code:
        same = code == rule.code
        hit, score = same | hit, F.when(same, F.lit(1.0)).otherwise(similarity)
    return Entry(rule.rule_id, hit, score, rule.desc, rule.weight)


def _fuzzy_term(rules: list[Rule], features: Features, kind: str, audit: bool, udfs: dict[str, Column]) -> Term:
    """All fuzzy rules of one column share one similarity call per value."""
    column = rules[0].column
    most = sum(max(r.weight, 0.0) for r in rules)
    code = features.get(column, "code") if any(r.code_prefer and r.code for r in rules) else None
    if kind == "contains":
        text = X.blank_null(features.get(column, "spaced"))
        sims = [F.contains(text, F.lit(r.spaced)).cast("double") for r in rules]
    else:
        name = f"__z{len(udfs)}"
        text = features.get(column, "strict" if kind == "sequence" else "spaced")
        targets = [r.strict if kind == "sequence" else r.spaced for r in rules]
        if not audit:
            prefer = [r.code if r.code_prefer else "" for r in rules]
            fold = fuzzy_fold(targets, prefer, [r.threshold for r in rules], [r.weight for r in rules], kind)
            udfs[name] = fold(text, F.lit("") if code is None else code)
            z = F.col(name)
            return Term(z["any"], z["all"], z["total"], [], most, costly=True)
        udfs[name] = fuzzy_scores(targets, kind)(text)
        sims = [F.col(name)[i] for i in range(len(rules))]
    entries = [_fuzzy_entry(r, s, code) for r, s in zip(rules, sims)]
    return Term(
        any_of([e.hit for e in entries]),
        all_of([e.hit for e in entries]),
        in_order_sum([e.score * F.lit(e.weight) for e in entries]),
        entries,
        most,
        costly=kind != "contains",
    )


def _build_terms(
    rules: Sequence[Rule],
    features: Features,
    group_contains: bool,
    similarity: str,
    audit: bool,
    udfs: dict[str, Column],
    steps: dict[str, Column],
) -> list[Term]:
    """Rules gathered into groups, a group standing where its first rule stands."""
    groups: dict[tuple, list[Rule]] = {}
    for r in rules:
        if r.problem or r.column not in features.types:
            key = ("never", r.rule_id)
        elif _is_lookup(r):
            key = ("lookup", r.column, "code" if r.type == "code" else _fold_kind(r))
        elif r.type == "fuzzy":
            key = ("fuzzy", r.column)
        elif r.type == "text" and r.operator == "contains" and group_contains:
            key = ("keywords", r.column, r.options)
        else:
            key = ("single", r.rule_id)
        groups.setdefault(key, []).append(r)
    terms = []
    for (kind, *_), members in groups.items():
        asked = features.asked
        if kind == "never":
            terms.append(_single_term(members[0], F.lit(False)))
        elif kind == "lookup":
            terms.append(_lookup_term(members, features, audit))
        elif kind == "fuzzy":
            terms.append(_fuzzy_term(members, features, similarity, audit, udfs))
        elif kind == "keywords":
            terms.append(_keyword_term(members, features, steps))
        else:
            terms.append(_single_term(members[0], _single_hit(members[0], features)))
        terms[-1].plain = features.asked == asked and not terms[-1].costly
    return terms


def _threshold(value: float | str) -> float:
    if isinstance(value, str):
        text = value.strip()
        return float(text[:-1]) / 100.0 if text.endswith("%") else float(text)
    return float(value)


@dataclass
class Screening:
    """The expressions of one rule set over one table."""

    df: DataFrame
    features: Features
    terms: list[Term]
    udfs: dict[str, Column]
    steps: dict[str, Column]
    mode: str
    threshold: float
    in_groups: bool  # whether the groups' own sums may be added up

    def total(self) -> Column:
        """The scores in the order of the rules; by groups where that gives the same double."""
        if self.in_groups:
            return in_order_sum([t.total for t in self.terms])
        return in_order_sum([e.score * F.lit(e.weight) for e in self.entries()])

    def match(self) -> Column:
        """May be null where a value is null; null means no hit."""
        if self.mode == "AND":
            return all_of([t.all for t in self.terms])
        if self.mode == "OR":
            return any_of([t.any for t in self.terms])
        return self.total() >= F.lit(self.threshold)

    def _with_udfs(self, df: DataFrame) -> DataFrame:
        made = {**self.steps, **self.udfs}
        return df.select("*", *(c.alias(n) for n, c in made.items())) if made else df

    def base(self) -> DataFrame:
        """The table with derived columns and UDF results."""
        return self._with_udfs(self.features.project(self.df))

    def hits(self) -> DataFrame:
        """The same for the hits alone; rows that can hit no more leave as early as they can."""
        if self.mode == "AND":
            plain = [t.all for t in self.terms if t.plain]
            native = [t.all for t in self.terms if not t.plain and not t.costly]
            costly = [t.all for t in self.terms if t.costly]
            df = self.df.filter(all_of(plain)) if plain else self.df
            df = self.features.project(df)
            df = df.filter(self.features.settled(all_of(native))) if native else df
            df = self._with_udfs(df)
            return df.filter(all_of(costly)) if costly else df
        df = self.features.project(self.df)
        native = [t.total for t in self.terms if not t.costly]
        if self.mode == "WEIGHTED" and (self.udfs or self.steps) and native:
            reachable = sum(t.most for t in self.terms if t.costly) + SLACK
            possible = in_order_sum(native) + F.lit(reachable) >= F.lit(self.threshold)
            df = df.filter(self.features.settled(possible))
        return self._with_udfs(df).filter(self.features.settled(self.match()))

    def entries(self) -> list[Entry]:
        return sorted((e for t in self.terms for e in t.entries), key=lambda e: e.rule_id)


def _adds_exactly(rules: Sequence[Rule], similarity: str) -> bool:
    """Whether no sum of these scores is ever rounded, so that their order doesn't matter.

    That holds for scores of 0 and 1 with weights in whole 1/1024, and for a single group, which has its own order.
    """
    fuzzy = [r for r in rules if r.type == "fuzzy"]
    if fuzzy and similarity != "contains":
        return len(fuzzy) == len(rules) and len({r.column for r in rules}) == 1 and not any(r.problem for r in rules)
    weights = [r.weight * 1024 for r in rules]
    return all(w == int(w) for w in weights if abs(w) < 2**50) and sum(map(abs, weights)) < 2**50


def plan_screening(
    df: DataFrame,
    rules,
    mode: str = "OR",
    threshold: float | str = 0.8,
    group_contains: bool = True,
    similarity: str = "sequence",
    on_invalid: str = "false",
    audit: bool = False,
) -> Screening:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if similarity not in SIMILARITIES:
        raise ValueError(f"similarity must be one of {SIMILARITIES}")
    rule_set: RuleSet = as_rule_set(df.sparkSession, rules)
    chosen = [r for r in rule_set.rules if not (on_invalid == "skip" and r.problem in ("bad number", "bad range"))]
    features, udfs, steps = Features(df), {}, {}
    in_groups = _adds_exactly(chosen, similarity)
    terms = _build_terms(chosen, features, group_contains, similarity, audit or not in_groups, udfs, steps)
    return Screening(df, features, terms, udfs, steps, mode, _threshold(threshold), in_groups)


def screen(df: DataFrame, rules, audit: bool = False, hits_only: bool = False, **settings) -> DataFrame:
    """Add ``_match_all`` and ``_score_all``; with ``audit`` also three columns per rule or keyword group.

    ``hits_only`` keeps the hits and gives the optimizer the bare predicate, so that it can reach the scan.
    """
    s = plan_screening(df, rules, audit=audit, **settings)
    base = s.hits() if hits_only else s.base()
    match = F.lit(True) if hits_only else F.coalesce(s.match(), F.lit(False))
    out = [F.col(quoted(c)) for c in df.columns]
    if audit:
        for i, e in enumerate(s.entries(), start=1):
            out.append(F.coalesce(e.hit, F.lit(False)).alias(f"_cond_{i}_match"))
            out.append(P.round4(e.score).alias(f"_cond_{i}_score"))
            out.append(F.lit(e.desc).alias(f"_cond_{i}_desc"))
    return base.select(*out, match.alias(MATCH), P.round4(s.total()).alias(SCORE))


def keep_hits(screened: DataFrame) -> DataFrame:
    return screened.filter(F.col(MATCH))


def audit_long(df: DataFrame, rules, keys: Sequence[str], **settings) -> DataFrame:
    """The audit as one row per (row, rule or keyword group): keys, rule_id, hit, score, desc."""
    s = plan_screening(df, rules, audit=True, **settings)
    facts = [
        F.struct(
            F.lit(i).alias("rule_id"),
            F.coalesce(e.hit, F.lit(False)).alias("hit"),
            P.round4(e.score).alias("score"),
            F.lit(e.desc).alias("desc"),
        )
        for i, e in enumerate(s.entries(), start=1)
    ]
    return s.base().select(*(F.col(quoted(k)) for k in keys), F.inline(F.array(*facts)))


def hits_long(df: DataFrame, rules, keys: Sequence[str], **settings) -> DataFrame:
    """What counts towards the fold, one row per (row, rule): keys, rule_id, hit, score, weight.

    Rules that neither hit nor score are left out; a table row without any gives one row of nulls.
    Set rules (text equality, enum, code) are found by an equi-join of the row's values with the rules' values,
    which does not grow with the number of rules. The rules' side is broadcast up to a measured size.
    """
    s = plan_screening(df, rules, audit=True, **settings)
    null = F.lit(None)

    def fact(group, value, rule_id, hit, score, weight) -> Column:
        return F.struct(
            F.lit(group).cast("int").alias("__group"),
            value.cast("string").alias("__value"),
            F.lit(rule_id).cast("int").alias("rule_id"),
            F.coalesce(hit, F.lit(False)).alias("hit"),
            score.cast("double").alias("score"),
            F.lit(weight).cast("double").alias("weight"),
        )

    facts, rule_rows = [], []
    for group, term in enumerate(s.terms):
        if term.lookup:
            value, by_key = term.lookup
            facts.append(fact(group, value, None, F.lit(False), null, None))
            rule_rows += [(group, k, e.rule_id, e.weight) for k, es in by_key.items() for e in es]
        else:
            facts += [fact(None, null, e.rule_id, e.hit, e.score, e.weight) for e in term.entries]
    telling = F.filter(F.array(*facts), lambda x: x["__group"].isNotNull() | (x["score"] != 0.0) | x["hit"])
    key_cols = [F.col(quoted(k)) for k in keys]
    long = s.base().select(*key_cols, F.inline_outer(telling))

    columns = {"__group": pa.int32(), "__value": pa.string(), "__rule": pa.int32(), "__weight": pa.float64()}
    arrays = [pa.array([r[i] for r in rule_rows], t) for i, t in enumerate(columns.values())]
    lookup = df.sparkSession.createDataFrame(pa.table(arrays, names=list(columns)))
    size = sum(len(r[1].encode()) + 32 for r in rule_rows)
    lookup = F.broadcast(lookup) if size <= BROADCAST_BYTES else lookup
    found = F.col("__rule").isNotNull()
    return long.join(lookup, ["__group", "__value"], "left").select(
        *key_cols,
        F.coalesce("__rule", "rule_id").alias("rule_id"),
        (found | F.col("hit")).alias("hit"),
        F.when(found, F.lit(1.0)).otherwise(F.col("score")).alias("score"),
        F.coalesce("__weight", "weight").alias("weight"),
    )


def fold_hits(hits: DataFrame, keys: Sequence[str], n_entries: int, mode: str = "OR", threshold: float = 0.8) -> DataFrame:
    """Fold long hits per row key: ``_match_all`` and ``_score_all`` as the single-pass form gives them.

    The scores of one row, at most one per rule, are added in rule order.
    """
    scored = F.when(F.col("rule_id").isNotNull(), F.struct("rule_id", (F.col("score") * F.col("weight")).alias("x")))
    grouped = hits.groupBy(*(F.col(quoted(k)) for k in keys)).agg(
        F.count_if("hit").alias("__n"), F.sort_array(F.collect_list(scored)).alias("__x")
    )
    total = F.aggregate("__x", F.lit(0.0), lambda a, e: a + e["x"])
    match = {
        "AND": F.col("__n") == n_entries,
        "OR": F.col("__n") > 0,
        "WEIGHTED": total >= F.lit(_threshold(threshold)),
    }[mode]
    return grouped.select(*(F.col(quoted(k)) for k in keys), match.alias(MATCH), P.round4(total).alias(SCORE))


def fold_rows(df: DataFrame, rules, keys: Sequence[str], mode: str = "OR", threshold: float = 0.8, **settings) -> DataFrame:
    """``fold_hits`` of ``hits_long`` within each row: the facts of a row stay an array, so no row is shuffled.

    Set rules are found by one broadcast join for each column and kind of text; beyond the measured size of a broadcast
    that join is a shuffle. Repeated keys stay rows of their own. The arrays grow with the rules that hit, not with all.
    """
    s = plan_screening(df, rules, audit=True, **settings)
    fact = "struct<rule_id:int,hit:boolean,x:double>"
    own, base, found = [], s.base(), []
    for group, term in enumerate(s.terms):
        if not term.lookup:
            hits = [(e.rule_id, F.coalesce(e.hit, F.lit(False)), F.coalesce(e.score, F.lit(0.0)) * F.lit(float(e.weight))) for e in term.entries]
            own += [F.struct(F.lit(i).alias("rule_id"), hit.alias("hit"), x.alias("x")).cast(fact) for i, hit, x in hits]
            continue
        value, by_key = term.lookup
        base = base.withColumn(f"__value{group}", value.cast("string"))
        found.append((group, by_key))
    facts = F.array(*own) if own else F.array().cast(f"array<{fact}>")
    telling = F.filter(facts, lambda f: f["hit"] | (f["x"] != 0.0)).alias("__facts")
    rows = base.select(*(F.col(quoted(k)) for k in keys), *(f"__value{group}" for group, _ in found), telling)
    for group, by_key in found:
        listed = [(k, [(e.rule_id, True, float(e.weight)) for e in es]) for k, es in by_key.items()]
        size = sum(len(k.encode()) + 32 * len(es) for k, es in listed)
        lookup = df.sparkSession.createDataFrame(listed, f"__value{group} string, __found array<{fact}>")
        rows = rows.join(F.broadcast(lookup) if size <= BROADCAST_BYTES else lookup, f"__value{group}", "left")
        more = F.when(F.col("__found").isNull(), F.col("__facts")).otherwise(F.concat("__facts", "__found"))
        rows = rows.withColumn("__facts", more).drop("__found", f"__value{group}")
    total = F.aggregate(F.array_sort("__facts"), F.lit(0.0), lambda a, f: a + f["x"])
    n = F.size(F.filter("__facts", lambda f: f["hit"]))
    match = {"AND": n == len(s.entries()), "OR": n > 0, "WEIGHTED": total >= F.lit(_threshold(threshold))}[mode]
    return rows.select(*(F.col(quoted(k)) for k in keys), match.alias(MATCH), P.round4(total).alias(SCORE))


def _with_total(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The counts per source and one row for all, whose source columns are null."""
    sets = [[F.col(c) for c in by], []]
    return counts.groupingSets(sets, *by).agg(F.sum("rows").alias("rows"), F.sum("hits").alias("hits"))


def hits_per_source(screened: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and hits per source and in total, from rows that are screened but not yet filtered."""
    counts = screened.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.col(MATCH)).alias("hits"))
    return _with_total(counts, by)


def source_totals(rows: DataFrame, hits: DataFrame, source: str) -> DataFrame:
    """The same from counts taken apart: (source, rows) and (source, hits)."""
    both = rows.join(hits, source, "full")
    counts = both.select(source, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "hits")))
    return _with_total(counts, [source])


def rows_per_source(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"))
