"""Fixed schemas."""

from __future__ import annotations

# The columns of a rule table, in order.
RULE_COLUMNS = ("column", "type", "operator", "value", "threshold", "priority", "weight", "options")

DIAGNOSTIC_SCHEMA = "rule_id int, column string, type string, operator string, value string, problem string"

# Provenance columns that every table source adds.
SOURCE, SHEET, ROW = "_source_file", "_sheet", "_row_idx"


def quoted(name: str) -> str:
    """A column name safe for ``F.col``, whatever characters the header held."""
    return "`" + name.replace("`", "``") + "`"
