"""The rule contract in plain Python, row by row, to compare the Spark jobs with on small inputs."""

import re
from difflib import SequenceMatcher

NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?inf(inity)?", re.IGNORECASE)
TRUE = {"true", "1", "yes", "y", "t"}


def half(text):
    return text.translate({0x3000: 32, **{c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}})


def strict(text):
    return re.sub("[^0-9a-z一-鿿]", "", half(text).lower())


def code(text):
    found = re.search("[0-9]{4,6}", text)
    return found.group() if found else ""


def number(text):
    text = text.strip()
    return float(text) if NUMBER.fullmatch(text) else None


def options(text):
    parts = [p.strip() for p in text.split(";") if p.strip()]
    return {k.strip(): (v.strip() if eq else "true") for k, eq, v in (p.partition("=") for p in parts)}


def share(text):
    value = number(text.strip().removesuffix("%"))
    if not text.strip() or value is None:
        return 0.0
    return value / 100 if text.strip().endswith("%") else value


def span(text):
    one = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    found = re.fullmatch(f"({one})-({one})(-.*)?", text.replace(" ", ""))
    return (float(found[1]), float(found[2])) if found else None


def fold(text, opts):
    if opts.get("normalize", "").lower() == "true":
        return strict(text)
    return text.lower() if opts.get("ignore_case", "").lower() == "true" else text


def judge(rule, row):
    """(hit, score) of one rule for one row."""
    column, kind, op, value, threshold, _, _, opt = (*rule, *[""] * (8 - len(rule)))
    if column not in row:
        return False, 0.0
    text, opts = row[column] or "", options(opt)
    own, asked = fold(text, opts), fold(value, opts)
    hit = False
    if kind == "text":
        tests = {"equals": str.__eq__, "startswith": str.startswith, "endswith": str.endswith, "contains": str.__contains__}
        hit = op in tests and tests[op](own, asked) and not (op == "contains" and not asked)
    elif kind == "enum" and op == "in":
        hit = bool(own) and own in [fold(x.strip(), opts) for x in value.split(";")]
    elif kind == "boolean" and op == "is":
        hit = (text.lower() in TRUE) == (value.lower() in TRUE)
    elif kind == "code" and op == "equals":
        hit = code(text) != "" and code(text) == re.sub("[^0-9]", "", value)
    elif kind == "regex" and op == "match":
        try:
            hit = re.search(value, text) is not None
        except re.error:
            hit = False
    elif kind == "number":
        x, limit = number(text), number(value)
        if op == "between" and x is not None and span(value):
            hit = span(value)[0] <= x <= span(value)[1]
        elif x is not None and limit is not None:
            hit = {"min": x >= limit, "max": x <= limit, "equals": x == limit}.get(op, False)
    elif kind == "fuzzy" and op == "similar":
        if opts.get("code_prefer", "").lower() == "true" and code(text) and code(text) == code(value):
            return True, 1.0
        score = SequenceMatcher(None, strict(text), strict(value)).ratio()
        return score >= share(threshold), score
    return hit, float(hit)


def weight(rule):
    value = number(rule[6]) if len(rule) > 6 and rule[6] else 1.0
    return 1.0 if value is None else value


def screen(rules, row, mode, threshold=0.8):
    """(match, score) of a row; keywords of one column and option text count once."""
    groups = {}
    for i, rule in enumerate(rules):
        keyword = rule[1:3] == ("text", "contains")
        groups.setdefault((rule[0], rule[7] if len(rule) > 7 else "") if keyword else i, []).append(rule)
    hits, total = [], 0.0
    for members in groups.values():
        judged = [judge(r, row) for r in members]
        hits.append(any(h for h, _ in judged))
        total += max(s for _, s in judged) * weight(members[0])
    match = {"AND": all(hits), "OR": any(hits), "WEIGHTED": total >= threshold}[mode]
    return match, total


def _agreement(own, own_code, name, req_code):
    """The first tier of the contract that holds, else the ratio of matching blocks."""
    norm = strict(name)
    inside = "" not in (own, norm) and (own in norm or norm in own)
    tiers = {1.0: own_code != "" and own_code == req_code, 0.95: own == norm, 0.9: inside}
    return max((score for score, holds in tiers.items() if holds), default=SequenceMatcher(None, own, norm).ratio())


def best(text, reqs, threshold):
    """(match, name, code, score): the highest score, of equals the earliest requirement, given as (name, code)."""
    if not text:
        return (False, "", "", 0.0)
    ranked = [(_agreement(strict(text), code(text), *req), -place) for place, req in enumerate(reqs)]
    score, place = max(ranked, default=(0.0, 0))
    hit = score > 0 and score >= threshold
    return (hit, *(reqs[-place] if hit else ("", "")), score)
