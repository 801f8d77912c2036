"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target T and size S is wanted T/S times: the whole copies are taken as they are, the
fraction is a probability. Two open fractions meet at a time; words move from one to the other, by a coin that keeps
both expectations, until one of them is 0 or 1. So the words taken stay the same to the last open fraction, and a
source ends within one document of its target. The pairs are formed inside blocks of about ``BLOCK`` rows, whose
residuals meet in the blocks of the next level: a reduction tree, in which no task sees a whole source.

Coins are hashes of id, size and level, so that reruns agree.

Defined results: null and empty texts have size 0, and none of them is taken; null ids and repeated rows are documents
of their own; a null source comes last; a source without words has target 0 unless no source has words; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import SPACES, column
from ruleloom.session import staged

BLOCK = 128
MOST = 3  # copies of a document, and size of a target in sizes of its source
WEIGHTS = (1, 2, 3)
EDGE = 1e-9


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``id, source, size``; a size is the number of words between blanks."""
    words = F.regexp_count(F.coalesce(column(text), F.lit("")), F.lit(SPACES.replace("[", "[^", 1)))
    return docs.select(column(doc_id).alias("id"), column(source).alias("source"), words.cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, documents, target``, one row per source.

    The excess of capped sources is shared again among the others by weight. Both are settled at once: in the order
    of most*size/weight a source is capped as long as its share of what the earlier ones leave exceeds its cap.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    # One row per source from here on: the windows run over the sources, not over the documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    totals = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    cap = F.col("source_size") * float(most)
    ratio = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    totals = totals.withColumn("left", left).withColumn("others", F.sum("weight").over(from_here))
    share = F.col("left") * F.col("weight") / F.col("others")
    totals = totals.withColumn("capped", share > cap)
    # The first source that is not capped fixes the rate of all after it.
    rate = F.min(F.when(~F.col("capped"), F.struct(cap / F.col("weight"), F.col("left") / F.col("others")))).over(everything)
    target = F.when(F.col("capped"), cap).otherwise(F.col("weight") * rate["col2"])
    return totals.select("source", "source_size", "documents", F.least(target, cap).alias("target"))


def _coin(unit: Column, level: int) -> Column:
    whole = F.xxhash64(unit["id"], unit["size"], unit["tie"], F.lit(level))
    return F.pmod(whole, F.lit(1 << 52)).cast("double") / float(1 << 52)


def _unit(p: Column, unit: Column) -> Column:
    return F.struct(unit["tie"].alias("tie"), unit["id"].alias("id"), unit["size"].alias("size"), unit["base"].alias("base"), p.alias("p"))


def _round_block(units: Column, level: int) -> Column:
    """Fold a block: ``open`` is the unit that still has a fraction, ``done`` are the settled ones."""
    nothing = F.filter(units, lambda u: F.lit(False))
    first = F.struct(F.element_at(units, 1).alias("open"), nothing.alias("done"))

    def meet(state: Column, b: Column) -> Column:
        a = state["open"]
        # Words that may flow to a (up) and to b (down) until one of the two is settled.
        up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
        down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        goes_up = _coin(b, level) * (up + down) < down
        words = F.when(goes_up, up).otherwise(-down)
        pa = a["p"] + words / a["size"]
        pb = b["p"] - words / b["size"]
        exact = lambda p: F.when(p < EDGE, F.lit(0.0)).when(p > 1 - EDGE, F.lit(1.0)).otherwise(p)
        both = F.struct(_unit(exact(pa), a).alias("a"), _unit(exact(pb), b).alias("b"))

        def settle(x: Column) -> Column:
            keep_a = (x["a"]["p"] > 0) & (x["a"]["p"] < 1)
            return F.struct(
                F.when(keep_a, x["a"]).otherwise(x["b"]).alias("open"),
                F.concat(state["done"], F.array(F.when(keep_a, x["b"]).otherwise(x["a"]))).alias("done"),
            )

        # A transform over one element names the pair, which is then used several times.
        return F.element_at(F.transform(F.array(both), settle), 1)

    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), first, meet)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per document ``id, source, size, source_size, target, copies``."""
    sized = staged(sizes(docs, doc_id, text, source), "sizes")
    plan = staged(targets(sized, weights), "targets")
    same = sized["source"].eqNullSafe(plan["source"])
    wanted = sized.join(F.broadcast(plan), same).select(sized["*"], plan["source_size"], plan["documents"], plan["target"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = wanted.withColumn("rate", F.least(rate, F.lit(float(MOST))))
    near = F.abs(F.col("rate") - F.round("rate")) < EDGE
    base = F.when(near, F.round("rate")).otherwise(F.floor("rate")).cast("long")
    wanted = wanted.withColumn("base", base).withColumn("p", F.when(near, F.lit(0.0)).otherwise(F.col("rate") - F.col("base")))
    is_open = (F.col("size") > 0) & (F.col("p") > 0)
    closed = wanted.filter(~is_open).select("id", "source", "size", F.when(F.col("size") > 0, F.col("base")).otherwise(F.lit(0)).alias("copies"))
    # Repeated rows are counted first, so that a thousand of them don't meet in one block.
    same_rows = wanted.filter(is_open).groupBy("source", "id", "size", "base", "p", "documents").agg(F.count("*").alias("rows"))
    each = same_rows.select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("tie"))
    blocks = F.greatest(F.ceil(F.col("documents") / BLOCK), F.lit(1))
    unit = F.struct(F.xxhash64("id", "size", "tie").alias("tie"), "id", "size", "base", "p")
    level = each.select("source", F.pmod(F.xxhash64("id", "tie", F.lit("block")), blocks).alias("block"), blocks.alias("blocks"), unit.alias("unit"))
    results, depth, most = [closed], 0, plan.agg(F.max("documents")).first()[0] or 0
    width = -(-most // BLOCK)
    while True:
        folded = level.groupBy("source", "block").agg(F.first("blocks").alias("blocks"), F.sort_array(F.collect_list("unit")).alias("units"))
        folded = folded.select("source", "block", "blocks", _round_block(F.col("units"), depth).alias("state"))
        folded = staged(folded, f"rounded-{depth}")
        done = folded.select("source", F.explode("state.done").alias("u"))
        results.append(done.select("u.id", "source", "u.size", (F.col("u.base") + F.col("u.p").cast("long")).alias("copies")))
        if width <= 1:
            last = folded.select("source", F.col("state.open").alias("u"))
            take = F.when(F.col("u.p") >= 0.5, F.lit(1)).otherwise(F.lit(0))  # the one open document goes the nearer way
            results.append(last.select("u.id", "source", "u.size", (F.col("u.base") + take).alias("copies")))
            break
        # A residual that is settled already passes on unchanged: its coin can move no words.
        fewer = F.greatest(F.ceil(F.col("blocks") / BLOCK), F.lit(1))
        level = folded.select("source", F.pmod(F.xxhash64("block"), fewer).alias("block"), fewer.alias("blocks"), F.col("state.open").alias("unit"))
        width, depth = -(-width // BLOCK), depth + 1
    union = reduce(DataFrame.unionByName, results)
    same = union["source"].eqNullSafe(plan["source"])
    return union.join(F.broadcast(plan), same).select(
        "id", union["source"], "size", "source_size", "target", F.col("copies").cast("long").alias("copies")
    )


def report(docs: DataFrame) -> DataFrame:
    found = mixed(docs.select("doc_id", "text", "source"))
    return found.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
