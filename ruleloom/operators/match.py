"""Best match of a text column against a requirement list.

Each value takes its best-scoring requirement, the earliest one on ties:
equal code 1.0, equal normalised text 0.95, one text inside the other 0.9, else the matching-block ratio.

A list of up to ``SHIPPED_LIST`` requirements goes to the rows, which are judged where they lie. A longer one stays a table:

1. Equal codes and equal texts are joins of the distinct values with the earliest requirement of each key.
2. One text lies inside another only if the other has its rarest pair of characters; texts meet by that pair, and
   containment is then tested. Texts of one character meet by it.
3. Ratios: values and texts are dealt into blocks, and each block of values meets each block of texts in one task, which
   measures only pairs whose bounds on shared characters and common subsequences reach the best score known.
4. The rows are joined with the results of their values. A popular value has one result, however many rows it has.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ruleloom.functions import text as X
from ruleloom.functions.nearest import nearest
from ruleloom.functions.params import round4
from ruleloom.functions.similarity import each_once
from ruleloom.operators.dedup import keep_first
from ruleloom.operators.ordering import POSITION, with_position
from ruleloom.schema import SOURCE, quoted
from ruleloom.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # as in the similarity module

# The scores of the first three tiers.
SAME_CODE, SAME_TEXT, INSIDE = 1.0, 0.95, 0.9
# Fixed value: a requirement written as a name with its code in full-width brackets.
BRACKETED = r"(?U)^(.*?)（\s*([0-9]{4,6}[A-Z]{0,3})\s*）"
BARE_CODE = r"^[0-9]{4,6}[A-Z]{0,3}$"

PLAIN_LIST = 500  # requirements up to which the exact tiers are native expressions; longer lists use the same search
SHIPPED_LIST = 2000  # requirements up to which the list goes to the rows
BLOCK = 4096  # values, and texts of a longer list, that meet in one task
RESULT_BYTES = 32 << 20  # results of distinct values up to which they are broadcast to the rows
BLOCK_TYPE = "array<struct<pos:bigint,norm:string>>"


def parse_requirements(lines: DataFrame, line: str = "line", index: str = "_row_idx") -> DataFrame:
    """Lines to requirements ``raw, name, norm, code, req_idx``; distinct on (norm, code), the first line stays.

    Lines of several files are numbered on, file by file, so that a number names one line.
    """
    if SOURCE in lines.columns:
        lines = with_position(lines, [SOURCE, index]).withColumn(index, F.col(POSITION) - 1)
    raw = F.col(quoted(line))
    text = X.strip(X.blank_null(raw))
    words = F.split(F.regexp_replace(text, X.WHITESPACE_RUN, " "), " ")
    named = F.filter(words, lambda w: ~w.rlike(BARE_CODE))
    last_word = F.when(F.size(named) > 0, F.element_at(named, -1)).otherwise(F.element_at(words, -1))
    bracketed = text.rlike(BRACKETED)
    name = F.when(bracketed, X.strip(F.regexp_extract(text, BRACKETED, 1))).otherwise(last_word)
    code = F.when(bracketed, X.digits_only(F.regexp_extract(text, BRACKETED, 2))).otherwise(X.extract_code(text))
    parsed = (
        lines.select(
            raw.alias("raw"),
            name.alias("name"),
            X.normalize_strict(name).alias("norm"),
            code.alias("code"),
            F.col(quoted(index)).cast("long").alias("req_idx"),
        )
        .filter(X.strip(X.blank_null("raw")) != "")
        .filter(F.col("name") != "")
    )
    return keep_first(parsed, [F.col("norm"), F.col("code")], [F.col("req_idx")])


def _inside(value: Column, norm: Column) -> Column:
    return (norm != "") & (value != "") & (norm != value) & (F.contains(value, norm) | F.contains(norm, value))


def _ladder(code_pos: Column, text_pos: Column, inside_pos: Column) -> Column:
    """Score and requirement position of the best of the first three tiers."""

    def step(score: float, pos: Column) -> Column:
        return F.struct(F.lit(score).alias("score"), pos.cast("long").alias("pos"))

    return (
        F.when(code_pos.isNotNull(), step(SAME_CODE, code_pos))
        .when(text_pos.isNotNull(), step(SAME_TEXT, text_pos))
        .when(inside_pos.isNotNull(), step(INSIDE, inside_pos))
        .otherwise(step(0.0, F.lit(None)))
    )


def _best_of(values: list[str], items: list[tuple[int, str]], ratios: bool) -> list[tuple[float, int | None]]:
    """Best score and requirement position of each value by text (all tiers but the code)."""
    best, best_pos = np.zeros(len(values)), np.full(len(values), np.inf)
    for pos, text in items:
        score = np.array([_text_tier(v, text) for v in values])
        better = (score > best) | ((score == best) & (score > 0.0) & (pos < best_pos))
        best, best_pos = np.where(better, score, best), np.where(better, pos, best_pos)
    if ratios:
        nearest(values, best, best_pos, [text for _, text in items], np.array([pos for pos, _ in items]))
    return [(b, None if np.isinf(p) else int(p)) for b, p in zip(best.tolist(), best_pos.tolist())]


def _text_tier(value: str, text: str) -> float:
    if value == text:
        return SAME_TEXT
    return INSIDE if value and text and (value in text or text in value) else 0.0


def _search(block: list[tuple[int, str, str, str]], ratios: bool):
    """UDF (normalised value, code) -> score, pos, name, code over (pos, name, norm, code) of a block; each distinct
    value of a task is tried once."""
    by_pos = {pos: (name, code) for pos, name, _, code in block}
    by_code: dict[str, int] = {}
    by_norm: dict[str, int] = {}
    for pos, _, norm, code in block:
        if code:
            by_code.setdefault(code, pos)
        by_norm.setdefault(norm, pos)
    items = [(pos, norm) for norm, pos in by_norm.items()]

    def compute(keys: list[tuple]) -> list[tuple]:
        tried = [norm for norm, code in keys if norm is not None and code not in by_code]
        found = dict(zip(tried, _best_of(tried, items, ratios))) if tried else {}
        best = [(SAME_CODE, by_code[code]) if code in by_code else found.get(norm, (0.0, None)) for norm, code in keys]
        return [(score, pos, *by_pos.get(pos, (None, None))) for score, pos in best]

    @pandas_udf("score double, pos long, name string, code string")
    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        cache: dict[tuple, tuple] = {}
        for norms, codes in batches:
            rows = each_once(list(zip(norms, codes)), cache, compute)
            frame = pd.DataFrame(rows, columns=["score", "pos", "name", "code"])
            yield frame.assign(pos=frame["pos"].astype("Int64"))

    return best.asNondeterministic()


def _literal(value, ddl: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def _native(norm: Column, code: Column, rows: list[tuple[int, str, str, str]]) -> Column:
    """The exact tiers of a short list without Python."""
    by_code: dict[str, int] = {}
    by_norm: dict[str, int] = {}
    for pos, _, text, number in rows:
        if number:
            by_code.setdefault(number, pos)
        by_norm.setdefault(text, pos)
    blocks = _literal([{"pos": p, "norm": n} for n, p in by_norm.items()], BLOCK_TYPE)
    code_pos = F.try_element_at(_literal(by_code, "map<string,int>"), code)
    text_pos = F.try_element_at(_literal(by_norm, "map<string,int>"), norm)
    inside = F.array_min(F.transform(F.filter(blocks, lambda r: _inside(norm, r["norm"])), lambda r: r["pos"]))
    names = _literal([{"n": name, "c": c} for _, name, _, c in rows], "array<struct<n:string,c:string>>")

    def named(best: Column) -> Column:
        chosen = F.try_element_at(names, best["pos"].cast("int"))
        return F.struct(best["score"].alias("score"), best["pos"].alias("pos"), chosen["n"].alias("name"), chosen["c"].alias("code"))

    return F.element_at(F.transform(F.array(_ladder(code_pos, text_pos, inside)), named), 1)


ORDER = ["req_idx", "norm", "code", "name"]


def _shipped(reqs: DataFrame, most: int) -> list[tuple[int, str, str, str]] | None:
    """A short list as (pos, name, norm, code), numbered in its order; None if it is longer."""
    rows = reqs.select(*ORDER).limit(most + 1).collect()
    if not rows:
        raise ValueError("the requirement list is empty")
    if len(rows) > most:
        return None
    first = sorted(rows, key=lambda r: (r["req_idx"], r["norm"], r["code"] or "", r["name"]))
    return [(pos, r["name"], r["norm"], r["code"] or "") for pos, r in enumerate(first, start=1)]


def _score(score, pos: Column) -> Column:
    """Orders by score and then by position, the earliest first."""
    return F.struct((F.lit(score) if isinstance(score, float) else score).alias("score"), (-pos).alias("before"))


def _pairs_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2))))


def _holding(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """Pairs ``needle, hay`` of different texts, one inside the other, of tables of distinct texts ``needle`` and ``hay``."""
    size = F.char_length("needle")
    places = hay.filter(F.char_length("hay") > 1)
    grams = staged(places.select("hay", F.explode(_pairs_of(F.col("hay"))).alias("gram")), "grams")
    many = grams.groupBy("gram").agg(F.count("*").alias("many"))
    asked = needles.filter(size > 1).select("needle", F.explode(_pairs_of(F.col("needle"))).alias("gram"))
    # A pair of characters that no text has rules its needle out: it is the rarest, and meets nothing.
    rarest = asked.join(many, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "gram")).alias("x"))
    met = rarest.filter("x.many > 0").select("needle", F.col("x.gram").alias("gram")).join(grams, "gram")
    single = needles.filter(size == 1)
    letters = places.select("hay", F.explode(F.array_distinct(F.split("hay", ""))).alias("needle"))
    met = met.select("needle", "hay").unionByName(letters.join(single, "needle").select("needle", "hay"))
    return met.filter((F.col("needle") != F.col("hay")) & F.contains("hay", F.col("needle")))


def _nearest_of_blocks(left: pa.Table, right: pa.Table) -> pa.Table:
    values, texts = left.column("norm").to_pylist(), right.column("norm").to_pylist()
    best = left.column("score").to_numpy().astype(np.float64)
    best_pos = left.column("pos").to_numpy(zero_copy_only=False).astype(np.float64)
    best_pos = np.where(np.isnan(best_pos), np.inf, best_pos)
    if values and texts:
        nearest(values, best, best_pos, texts, right.column("pos").to_numpy())
    found = np.isfinite(best_pos)
    pos = pa.array(np.where(found, best_pos, 0).astype(np.int64))
    return pa.table({"norm": left.column("norm"), "score": pa.array(best), "pos": pos}).filter(pa.array(found))


def _blocks_of(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // BLOCK))


def _text_results(texts: DataFrame, by_norm: DataFrame, ratios: bool) -> DataFrame:
    """``norm, score, pos`` of the distinct texts ``norm`` that have any, by all tiers but the code."""
    best = F.max("best").alias("best")
    same = texts.join(by_norm, "norm").select("norm", _score(SAME_TEXT, F.col("pos")).alias("best"))
    mine, listed = texts.filter("norm != ''"), by_norm.filter("norm != ''")
    value, text = (lambda name: mine.select(F.col("norm").alias(name))), (lambda name: listed.select(F.col("norm").alias(name)))
    inside = _holding(text("needle"), value("hay")).select(F.col("hay").alias("norm"), F.col("needle").alias("text"))
    inside = inside.unionByName(_holding(value("needle"), text("hay")).select(F.col("needle").alias("norm"), F.col("hay").alias("text")))
    inside = inside.join(listed.select(F.col("norm").alias("text"), "pos"), "text").select("norm", _score(INSIDE, F.col("pos")).alias("best"))
    found = same.unionByName(inside).groupBy("norm").agg(best)
    found = staged(found.select("norm", "best.score", (-F.col("best.before")).alias("pos")), "exact-tiers")
    if not ratios:
        return found
    parts, blocks = _blocks_of(mine), _blocks_of(listed)
    dealt = lambda n: F.pmod(F.xxhash64("norm"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = mine.join(found, "norm", "left").select("norm", F.coalesce("score", F.lit(0.0)).alias("score"), "pos", dealt(parts).alias("part"))
    left = left.select("*", every(blocks).alias("block"))
    right = listed.select("norm", "pos", dealt(blocks).alias("block")).select("*", every(parts).alias("part"))
    met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_nearest_of_blocks, "norm string, score double, pos long")
    met = met.select("norm", _score(F.col("score"), F.col("pos")).alias("best")).groupBy("norm").agg(best)
    blank = found.filter("norm = ''")
    return met.select("norm", "best.score", (-F.col("best.before")).alias("pos")).unionByName(blank)


def _joined(prepared: DataFrame, reqs: DataFrame, ratios: bool) -> DataFrame:
    """The rows with ``__best`` of a list of any length."""
    listed = with_position(reqs.select(*ORDER), ORDER).withColumnRenamed(POSITION, "pos")
    listed = staged(listed.select("name", "norm", "code", "pos"), "list")
    least = F.min("pos").alias("pos")
    by_code, by_norm = listed.filter("code != ''").groupBy("code").agg(least), staged(listed.groupBy("norm").agg(least), "texts")
    values = prepared.filter(F.col("__norm").isNotNull()).select(F.col("__norm").alias("norm"), F.coalesce("__code", F.lit("")).alias("code")).distinct()
    values = staged(values.join(by_code, "code", "left"), "values")
    coded = values.filter("pos is not null").select("norm", "code", F.lit(SAME_CODE).alias("score"), "pos")
    other = values.filter("pos is null").select("norm", "code")
    results = other.join(_text_results(staged(other.select("norm").distinct(), "norms"), by_norm, ratios), "norm")
    results = coded.unionByName(results.select(*coded.columns)).join(listed.select("pos", "name", F.col("code").alias("found")), "pos")
    best = F.struct("score", "pos", "name", F.coalesce("found", F.lit("")).alias("code")).alias("__best")
    results = staged(results.select(F.col("norm").alias("__n"), F.col("code").alias("__c"), best), "results")
    size = results.agg(F.coalesce(F.sum(F.octet_length("__n") + F.octet_length("__best.name") + 80), F.lit(0))).first()[0]
    same = (F.col("__norm") == F.col("__n")) & (F.coalesce("__code", F.lit("")) == F.col("__c"))
    return prepared.join(F.broadcast(results) if size <= RESULT_BYTES else results, same, "left")


def best_match(
    df: DataFrame, column: str, reqs: DataFrame, threshold: float = 0.8, similarity: str = "sequence", plain_list: int | None = None, shipped_list: int | None = None
) -> DataFrame:
    """Add ``_match, _matched_name, _matched_code, _score``; ``similarity="none"`` leaves the last tier out.

    ``plain_list`` and ``shipped_list`` set how long a list may be for the ways that need no join; no result depends on them.
    """
    if column not in df.columns:
        raise ValueError(f"column {column!r} does not exist")
    text = F.col(quoted(column)).cast("string")
    has_text = text.isNotNull() & (text != "")
    prepared = df.select(
        "*",
        F.when(has_text, X.normalize_strict(text)).alias("__norm"),
        F.when(has_text, X.extract_code(text)).alias("__code"),
    )
    ratios = similarity == "sequence"
    block = _shipped(reqs, SHIPPED_LIST if shipped_list is None else shipped_list)
    if block is None:
        scored = _joined(prepared, reqs, ratios)
    elif not ratios and len(block) <= (PLAIN_LIST if plain_list is None else plain_list):
        scored = prepared.withColumn("__best", _native(F.col("__norm"), F.col("__code"), block))
    else:
        scored = prepared.withColumn("__best", _search(block, ratios)(F.col("__norm"), F.col("__code")))
    score = F.coalesce("__best.score", F.lit(0.0))
    hit = F.col("__best.name").isNotNull() & (score >= F.lit(float(threshold)))
    return scored.select(
        *(F.col(quoted(c)) for c in df.columns),
        hit.alias("_match"),
        F.when(hit, F.col("__best.name")).otherwise(F.lit("")).alias("_matched_name"),
        F.when(hit, F.col("__best.code")).otherwise(F.lit("")).alias("_matched_code"),
        round4(score).alias("_score"),
    )
