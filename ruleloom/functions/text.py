"""Text normalisation and code extraction as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The full-width forms and their ASCII counterparts (U+3000 is the wide space).
FULL_WIDTH = "\u3000" + "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF_WIDTH = " " + "".join(map(chr, range(0x21, 0x7F)))

# The characters a text field is stripped of and whose runs count as one space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = f"[{WHITESPACE}]+"
CHINESE = "[\u4e00-\u9fff]"
NOT_STRICT = "[^0-9a-z\u4e00-\u9fff]"
CODE = "[0-9]{4,6}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_null(c: Column | str) -> Column:
    """Null counts as empty text."""
    return F.coalesce(_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def to_halfwidth(c: Column | str) -> Column:
    """U+3000 becomes a space, U+FF01..FF5E become ASCII."""
    return F.translate(_col(c), FULL_WIDTH, HALF_WIDTH)


def normalize_spaces(c: Column | str) -> Column:
    """Half-width, lower case, one space between words."""
    plain = F.translate(_col(c), FULL_WIDTH + WHITESPACE, HALF_WIDTH + " " * len(WHITESPACE))
    return F.btrim(F.regexp_replace(F.lower(plain), "  +", " "))


def normalize_strict(c: Column | str) -> Column:
    """Half-width, lower case, only digits, ASCII letters and Chinese characters are left."""
    # The translation also drops all ASCII marks, which leaves little to replace for the slower pattern.
    kept = [(f, h) for f, h in zip(FULL_WIDTH, HALF_WIDTH) if h.isalnum()]
    marks = [h for h in HALF_WIDTH if not h.isalnum()] + [f for f, h in zip(FULL_WIDTH, HALF_WIDTH) if not h.isalnum()]
    source = "".join(f for f, _ in kept) + "".join(marks) + "\n\r\t"
    bare = F.lower(F.translate(_col(c), source, "".join(h for _, h in kept)))
    return F.regexp_replace(bare, NOT_STRICT, "")


def extract_code(c: Column | str) -> Column:
    """The first run of four to six digits, or empty text."""
    return blank_null(F.regexp_extract(_col(c), CODE, 0))


def digits_only(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[^0-9]", "")


def has_chinese(c: Column | str) -> Column:
    return blank_null(c).rlike(CHINESE)
