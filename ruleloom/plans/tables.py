"""The given tables, and the inputs that the queries derive from them (in Spark and, as text, in SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions.text import FULL_WIDTH, HALF_WIDTH, WHITESPACE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FULL_SQL, HALF_SQL, SPACE_SQL = _sql(FULL_WIDTH), _sql(HALF_WIDTH), _sql(WHITESPACE)

MAJOR = "concat(p_name, '（', lpad(cast(p_partkey as string), 6, '0'), 'TK）')"
MAJOR_SQL = "concat(p_name, '（', lpad(cast(p_partkey as varchar), 6, '0'), 'TK）')"

# Half of the parts carry the bare name, so that the equal-text tier has something to find.
NAME_OR_MAJOR = f"case when p_size > 25 then p_name else {MAJOR} end"
NAME_OR_MAJOR_SQL = f"case when p_size > 25 then p_name else {MAJOR_SQL} end"


def halfwidth_sql(expr: str) -> str:
    return f"translate({expr}, {FULL_SQL}, {HALF_SQL})"


def strict_sql(expr: str) -> str:
    return f"regexp_replace(lower({halfwidth_sql(expr)}), '[^0-9a-z一-鿿]', '', 'g')"


def spaces_sql(expr: str) -> str:
    klass = "'[" + WHITESPACE + "]+'"
    return f"trim(regexp_replace(lower({halfwidth_sql(expr)}), {klass}, ' ', 'g'))"


def majors(spark: SparkSession, folder: str) -> DataFrame:
    """part with its name and code in one text, as a candidate table writes them."""
    return table(spark, folder, "part").select("p_partkey", F.expr(MAJOR).alias("major"))


def requirement_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One line per part, in all the spellings a requirement list uses, blank lines included."""
    line = """case when p_size <= 10 then concat(p_name, '（ ', lpad(cast(p_partkey as string), 6, '0'), 'TK ）')
                   when p_size <= 20 then concat('  ', p_name, ' ', lpad(cast(p_partkey as string), 5, '1'))
                   when p_size <= 30 then concat('1 ', p_type, '　', p_name)
                   when p_size <= 35 then '   '
                   else p_brand end"""
    return table(spark, folder, "part").select(F.expr(line).alias("line"), F.col("p_partkey").alias("_row_idx"))


REQUIREMENT_LINES_SQL = """select case
    when p_size <= 10 then concat(p_name, '（ ', lpad(cast(p_partkey as varchar), 6, '0'), 'TK ）')
    when p_size <= 20 then concat('  ', p_name, ' ', lpad(cast(p_partkey as varchar), 5, '1'))
    when p_size <= 30 then concat('1 ', p_type, '　', p_name)
    when p_size <= 35 then '   ' else p_brand end as line, p_partkey as req_idx from part"""


def requirements(spark: SparkSession, folder: str) -> DataFrame:
    """A requirement per distinct part name, with the code of its first part."""
    named = table(spark, folder, "part").groupBy("p_name").agg(F.min("p_partkey").alias("req_idx"))
    return named.select(
        F.concat("p_name", F.lit("（"), F.lpad(F.col("req_idx").cast("string"), 6, "0"), F.lit("）")).alias("line"),
        F.col("req_idx").alias("_row_idx"),
    )


REQUIREMENTS_SQL = f"""select p_name as name, {strict_sql("p_name")} as norm,
    lpad(cast(min(p_partkey) as varchar), 6, '0') as code, min(p_partkey) as req_idx from part group by p_name"""


def rule_table(spark: SparkSession, folder: str) -> DataFrame:
    """A rule table in the shape users ship: per name a fuzzy and a code rule, then keywords on another column."""
    names = table(spark, folder, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    code = F.lpad(F.col("k").cast("string"), 6, "0")
    fields = ["column", "type", "operator", "value", "threshold", "priority", "weight", "options"]

    def rules(*values) -> DataFrame:
        cols = [v if not isinstance(v, str) else F.lit(v) for v in values]
        return names.select(*(c.alias(f) for c, f in zip(cols, fields)), F.col("k").alias("__k"))

    fuzzy = rules("major", "fuzzy", "similar", F.col("p_name"), "0.8", "", "", "code_prefer=true")
    codes = rules("major", "code", "equals", code, "", "6", "", "")
    brands = table(spark, folder, "part").select("p_brand").distinct()
    words = brands.select(
        F.lit("p_brand").alias("column"),
        F.lit("text").alias("type"),
        F.lit("contains").alias("operator"),
        F.col("p_brand").alias("value"),
        F.lit("").alias("threshold"),
        F.lit("1").alias("priority"),
        F.lit("0.5").alias("weight"),
        F.lit("ignore_case=true").alias("options"),
    ).filter(F.col("p_brand").rlike("#1[0-9]$"))
    ranked = fuzzy.unionByName(codes).orderBy("__k", F.col("type").desc()).drop("__k")
    return ranked.unionByName(words)


def block_ratio_sql(pairs: str) -> str:
    """CTEs that give ``ratio(a, b, r)``, the matching-block ratio, for the distinct pairs (a, b) of a query."""
    best = """list_aggregate(flatten(list_transform(range(1, length(b) + 1), lambda j: list_transform(range(1, length(b) - j + 2),
        lambda n: {'n': case when contains(a, substr(b, j, n)) then -n else 0 end, 'i': instr(a, substr(b, j, n)), 'j': j}))), 'min')"""
    return f"""pairs(a, b) as ({pairs}),
    stretch(a0, b0, a, b, size) as (select a, b, a, b, 0::bigint from pairs union all
      select a0, b0, case when side = 0 then left(a, m.i - 1) else substr(a, m.i - m.n) end,
        case when side = 0 then left(b, m.j - 1) else substr(b, m.j - m.n) end, case when side = 0 then -m.n else 0 end
      from (select a0, b0, a, b, {best} as m from stretch where a <> '' and b <> '') cross join (values (0), (1)) s(side) where m.n < 0),
    ratio as (select a0 as a, b0 as b, case when a0 = b0 then 1.0::double else 2.0::double * sum(size)::double / (length(a0) + length(b0)) end as r
      from stretch group by a0, b0)"""


def token_ratio_sql(pairs: str) -> str:
    """CTEs that give ``ratio(a, b, r)``, the word-set ratio, for the distinct pairs (a, b) of a query."""

    def words(text: str) -> str:
        return f"list_distinct(list_filter(string_split({text}, ' '), lambda w: w <> ''))"

    def joined(items: str) -> str:
        return f"array_to_string(list_sort({items}), ' ')"

    mask = "list_sum(list_transform(range(1, length(x) + 1), lambda i: case when substr(x, i, 1) = c then 1::bigint << (i - 1) else 0 end))"
    full = "((1::bigint << length(x)) - 1)"
    masks = f"list_transform(list_filter(string_split(y, ''), lambda c: c <> ''), lambda c: ({mask})::bigint)"
    left = f"list_reduce([{full}] || {masks}, lambda s, m: (((s + (s & m)) | (s - (s & m))) & {full}))"
    return f"""pairs(a, b) as ({pairs}),
    split as (select a, b, {words('a')} as ta, {words('b')} as tb from pairs),
    parts as (select a, b, ta, tb, {joined('list_intersect(ta, tb)')} as z, {joined('list_filter(ta, lambda w: not list_contains(tb, w))')} as x,
      {joined('list_filter(tb, lambda w: not list_contains(ta, w))')} as y from split),
    sizes as (select *, length(z) + case when z <> '' then 1 else 0 end as base,
      case when x = '' then 0 else length(x) - bit_count({left}) end as common from parts),
    ratio as (select a, b, case when len(ta) = 0 or len(tb) = 0 then 0.0::double when z <> '' and (x = '' or y = '') then 1.0::double
      else greatest(2.0::double * (base + common) / (base + length(x) + base + length(y)),
        case when z <> '' then 2.0::double * length(z) / (length(z) + base + length(x)) else 0 end,
        case when z <> '' then 2.0::double * length(z) / (length(z) + base + length(y)) else 0 end) end as r from sizes)"""
