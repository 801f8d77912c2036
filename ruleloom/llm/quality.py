"""Quality rules: a decision list, learned by sequential covering from labelled text statistics.

``statistics`` counts in the row, by native functions. ``learn`` grows conjunctions of thresholds that describe the
rejected class: it adds the condition of the highest gain until no labelled good document is left inside, prunes the
last conditions again on rows that growing has not seen, keeps the rule if it is precise there, takes out what it
covers and goes on. ``verdict`` writes the rules as one ordered conditional expression.

The list is fitted on at most about ``MAX_LABELLED`` labelled rows, drawn by a hash of the id; nothing else is sampled.

Defined results: null and empty texts have zero counts and fail the base rule; null ids and labels are not learned
from, repeated rows are judged alike; without labels of both kinds the list is empty and only the base rule rejects;
further columns are kept by ``accepted``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import SPACES, bounded, column, spaced_words, unwrapped, wrapped

MAX_LABELLED = 20_000
MAX_RULES, MAX_CONDITIONS = 16, 3
MIN_COVER, MIN_PRECISION = 12, 0.98
CUTS = 24  # thresholds tried for a statistic

WINDOW = 5
SYMBOLS = "#*$%&|<>"  # fixed value
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("f_words", "f_word_chars", "f_symbols", "f_dup_lines", "f_repeated", "f_upper", "f_marks", "f_digits", "f_same")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and the struct ``__q`` of the counts and of the features for learning."""
    t = F.coalesce(column(text), F.lit(""))
    docs = docs.withColumn("__words", spaced_words(t))
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("__words") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("__words"), i + k) for k in range(WINDOW)]),
    )
    docs = docs.withColumn("__windows", F.when(F.size("__words") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumn("__lines", lines)
    n = F.size("__words")
    n_symbols = F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))
    counts = {
        "n_words": n,
        "word_chars": F.char_length(F.regexp_replace(t, SPACES, "")),
        "n_symbols": n_symbols,
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": _repeated(F.col("__windows")),
        "n_lines": F.size("__lines"),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "n_marks": F.regexp_count(t, F.lit(r"[!?]")),
        "n_digits": F.regexp_count(t, F.lit("[0-9]")),
        "n_distinct": F.size(F.array_distinct("__words")),
    }
    docs = docs.withColumn("__c", F.struct(*[c.cast("long").alias(k) for k, c in counts.items()]))
    c = F.col("__c")
    chars, words = F.greatest(c["word_chars"], F.lit(1)), F.greatest(c["n_words"], F.lit(1))
    ratios = (
        c["n_words"].cast("double"),
        c["word_chars"] / words,
        c["n_symbols"] / chars,
        c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
        c["n_repeat_words"] / words,
        c["n_upper"] / chars,
        c["n_marks"] / chars,
        c["n_digits"] / chars,
        1 - c["n_distinct"] / words,
    )
    fields = [*(c[k].alias(k) for k in COUNTS), *(r.alias(k) for k, r in zip(FEATURES, ratios))]
    return docs.withColumn("__q", F.struct(*fields)).drop("__words", "__windows", "__lines", "__c")


def _repeated(windows: Column) -> Column:
    """Words inside windows that occur at least twice; texts without such windows need one pass over the hashes."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(items: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            before = (k > 0) & (F.get(items, k - 1)["h"] == x["h"])
            return before | F.coalesce(F.get(items, k + 1)["h"] == x["h"], F.lit(False))

        return F.filter(items, same)

    def covered(items: Column) -> Column:
        return F.aggregate(
            F.array_sort(F.transform(again(items), lambda x: x["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"), (i + WINDOW).alias("end")),
            lambda s: s["n"],
        )

    # A transform over one element names the sorted hashes, which are then read at many places.
    once = F.element_at(F.transform(F.array(placed), covered), 1)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), once).otherwise(F.lit(0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.value if self.above else row[self.feature] <= self.value

    def expression(self, source: str) -> Column:
        value = F.col(f"{source}.{self.feature}")
        return value >= F.lit(self.value) if self.above else value <= F.lit(self.value)


def _candidates(rows: list[dict]) -> list[Condition]:
    found = []
    for feature in FEATURES:
        values = sorted({r[feature] for r in rows})
        step = max(1, len(values) // CUTS)
        for value in values[::step]:
            found += [Condition(feature, True, value), Condition(feature, False, value)]
    return found


def _precision(rows: list[dict], rule: list[Condition]) -> tuple[float, int]:
    inside = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    return (sum(inside) + 1) / (len(inside) + 2), len(inside)


def _grow(rows: list[dict]) -> list[Condition]:
    rule: list[Condition] = []
    inside = rows
    while len(rule) < MAX_CONDITIONS and any(not r["bad"] for r in inside):
        bad = sum(r["bad"] for r in inside)
        best, best_gain = None, 0.0
        share = bad / len(inside)
        for condition in _candidates([r for r in inside if r["bad"]]):
            kept = [r["bad"] for r in inside if condition.holds(r)]
            hit = sum(kept)
            gain = hit * (hit / len(kept) - share) if kept and hit >= MIN_COVER else 0.0
            if gain > best_gain:
                best, best_gain = condition, gain
        if best is None:
            break
        rule.append(best)
        inside = [r for r in inside if best.holds(r)]
    return rule


def learn_list(rows: list[dict]) -> list[list[Condition]]:
    """Rules for ``bad`` rows, in order; a row is a dict of the features, ``bad`` (0 or 1) and ``test`` (whether it prunes)."""
    grow, prune = [r for r in rows if not r["test"]], [r for r in rows if r["test"]]
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES and any(r["bad"] for r in grow):
        rule = _grow(grow)
        if not rule:
            break
        options = [rule[: n + 1] for n in range(len(rule))]
        rule = max(options, key=lambda r: (_precision(prune, r)[0], -len(r)))
        precision, covered = _precision(prune, rule)
        if covered < MIN_COVER // 3 or precision < min(MIN_PRECISION, (covered + 1) / (covered + 2)):
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r) for c in rule)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> list[list[Condition]]:
    """Fit the list on documents with a label (0 is rejected, 1 accepted); several labels of an id count by their least."""
    known = labels.filter(column(label).isin(0, 1) & column("doc_id").isNotNull())
    known = known.groupBy(column("doc_id").alias("__id")).agg((1 - F.min(column(label))).cast("int").alias("__bad"))
    known = bounded(known, F.col("__id"), MAX_LABELLED, known.count())
    docs = docs.select(column(doc_id).alias("__doc"), column(text).alias("text"))
    # The size of the sample bounds what is broadcast.
    rows = statistics(docs.join(F.broadcast(known), F.col("__doc") == F.col("__id")))
    rows = rows.select(
        "__q.*", F.col("__bad").alias("bad"), (F.pmod(F.xxhash64("__id"), F.lit(3)) == 0).alias("test"), F.col("__id").alias("id")
    )
    # Filtered here: Spark would move a filter below the statistics and count everything again inside it.
    found = [r.asDict() for r in rows.collect()]
    found = [r for r in found if not (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])]
    rows = sorted(found, key=lambda r: (r["id"], r["f_words"], r["f_symbols"]))
    return learn_list(rows)


def _base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


def verdict(rules: list[list[Condition]], source: str = "__q") -> Column:
    """The number of the first rule that rejects, from 1; 0 if none does."""
    chain = None
    for number, rule in enumerate(rules, start=1):
        test = rule[0].expression(source)
        for condition in rule[1:]:
            test = test & condition.expression(source)
        chain = F.when(test, F.lit(number)) if chain is None else chain.when(test, F.lit(number))
    return F.lit(0) if chain is None else chain.otherwise(F.lit(0))


def judged(docs: DataFrame, rules: list[list[Condition]], text: str = "text") -> DataFrame:
    """All columns, the statistics ``__q``, ``__base_failed``, ``__rule`` and ``__kept``."""
    scored = statistics(docs, text)
    scored = scored.withColumn("__base_failed", _base_failed(F.col("__q"))).withColumn("__rule", verdict(rules))
    return scored.withColumn("__kept", ~F.col("__base_failed") & (F.col("__rule") == 0))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that neither the base rule nor the list rejects, with all their columns."""
    rules = learn(docs, labels, doc_id, text)
    # The partition number keeps the filter above the statistics, which would be counted twice below it.
    scored = judged(wrapped(docs, column(text).alias("text")), rules).withColumn("__at", F.spark_partition_id())
    return unwrapped(scored.filter(F.col("__kept") & (F.col("__at") >= 0)))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return judged(docs, learn(docs, labels)).select(
        "doc_id",
        *(F.col(f"__q.{c}").alias(c) for c in COUNTS),
        F.col("__base_failed").alias("base_failed"),
        F.col("__kept").alias("kept"),
        F.col("__rule").alias("rule"),
    )
