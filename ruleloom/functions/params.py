"""Parsing of rule parameters (options, fractions, ranges, lists) as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleloom.functions.text import _col, blank_null, strip

# The accepted spelling of numbers and of truth.
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
NUMBER_TEXT = rf"^(?:{NUMBER}|[+-]?[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)$"
RANGE_TEXT = rf"^({NUMBER})-({NUMBER})(?:-.*)?$"
TRUE_WORDS = ("true", "1", "yes", "y", "t")


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is not a plain number (also NaN, '2d', '1.5f') is null."""
    text = strip(c)
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def parse_fraction(c: Column | str) -> Column:
    """'85%' and '0.85' both give 0.85; empty gives 0; bad text gives null."""
    text = strip(blank_null(c))
    percent = to_number(F.regexp_replace(text, "%$", "")) / F.lit(100.0)
    return F.when(text == "", F.lit(0.0)).when(text.endswith("%"), percent).otherwise(to_number(text))


def parse_threshold(c: Column | str) -> Column:
    """A threshold typed by hand: the percent sign is optional above 1; the result lies in [0, 1]."""
    number = to_number(F.replace(strip(c), F.lit("%"), F.lit("")))
    share = F.when(number > 1.0, number / 100.0).otherwise(number)
    return F.when(share.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def parse_range(c: Column | str) -> Column:
    """'lo-hi' to struct(lo, hi); both ends may be signed; null fields where it is no range."""
    text = F.replace(blank_null(c), F.lit(" "), F.lit(""))
    return F.struct(
        to_number(F.regexp_extract(text, RANGE_TEXT, 1)).alias("lo"),
        to_number(F.regexp_extract(text, RANGE_TEXT, 2)).alias("hi"),
    )


def to_bool(c: Column | str) -> Column:
    """True for true/1/yes/y/t in any case, false for all else, null included."""
    return F.lower(blank_null(c)).isin(*TRUE_WORDS)


def split_list(c: Column | str) -> Column:
    """'a; b;;c' to [a, b, c]."""
    return F.filter(F.transform(F.split(blank_null(c), ";"), strip), lambda x: x != "")


def parse_options(c: Column | str) -> Column:
    """'k=v;flag' to a map; a bare key means 'true', a repeated key keeps its last value."""

    def entry(part: Column) -> Column:
        cut = F.instr(part, "=")
        key = F.when(cut > 0, part.substr(F.lit(1), cut - 1)).otherwise(part)
        value = F.when(cut > 0, part.substr(cut + 1, F.length(part))).otherwise(F.lit("true"))
        return F.struct(strip(key).alias("key"), strip(value).alias("value"))

    def last_of_each(entries: Column) -> Column:
        def overridden(e: Column, i: Column) -> Column:
            return F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"])

        return F.map_from_entries(F.filter(entries, lambda e, i: ~overridden(e, i)))

    # The entries are held in a one-element array, so that they are built once and not once per comparison.
    return F.transform(F.array(F.transform(split_list(c), entry)), last_of_each)[0]


def option_on(options: Column, name: str) -> Column:
    return F.coalesce(F.lower(F.try_element_at(options, F.lit(name))) == "true", F.lit(False))


def round4(c: Column | str) -> Column:
    """Four decimals, half to even, on doubles as numpy does it."""
    return F.rint(_col(c) * F.lit(10000.0)) / F.lit(10000.0)
