"""Line deduplication by a deletion-neighbourhood join.

A line is its words between blanks. A line is dropped if an earlier line, in the order of (id, text key, line number),
has the same words, or lies within the edit bound: one word put in, left out or replaced, where the longer of the two
has ``MIN_WORDS`` words at least (so 1/8 of a line at most; shorter lines have to be equal). Blank lines stay.

1. Equal lines are folded first; only the earliest of them goes on.
2. Two lines within one edit share their first or their last half, of a length that both emit. Lines none of whose
   halves occurs in another line have no partner, and leave. This loses no pair.
3. The others emit their deletion neighbourhood: the line itself and, for each word, the line without it, as hashes.
   The hash is the xor of all (word, place) hashes, so all neighbours of a line come from one running xor.
4. Lines that meet under one hash with the word left out at the same place differ by a replacement, and a line that
   meets another's shortened form differs by that word. Each line asks for the earliest of its class only, so a class
   of a million lines makes a million pairs. The edit is then verified on the words.

With ``grown`` the bound grows with the line: lines of ``2 * EDIT_WORDS`` words or more may differ by one word in each
``EDIT_WORDS`` of the longer one. Such lines are found by their passages of ``PASSAGE`` words:

1. The mark of a passage is the least hash of its runs of ``GRAM`` words. A line has the marks of all its passages.
2. Cut into passages side by side, a line has more of them than edits are allowed, and an edit spoils one at most. So a
   partner has the mark of one of any ``allowed + 1`` passages. The line asks by the rarest; marks no other line has are
   the first of these, and a line with more of them than edits leaves.
3. A line asks the earliest line of each mark, and only if that is none, all earlier ones of a length that is allowed.
   An edit takes one word from the set of a line and adds one, so pairs whose sets lack more words of each other than
   edits are allowed are not formed; the sets are maps of ``64 * MAPS`` bits there, in which words may only coincide.
   The edit distance is then verified on the words.

Defined results: a null text has no lines; an empty one has one blank line; ids that are null come first; repeated rows
are later copies of each other that share an order, so they keep or lose the same lines; a very long line is a line;
an empty table gives no rows; further columns are kept by ``cleaned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import column, spaced_words, text_key, wrapped
from ruleloom.session import staged

MIN_WORDS = 8
BROADCAST_BYTES = 16 << 20  # places of lines up to which they go to the texts; more meet them by a shuffle
EDIT_WORDS = 20  # words to an edit of long lines
GRAM, PASSAGE = 5, 12  # (allowed + 1) * PASSAGE words are in any line that may have a partner, whatever its bound from 2 on
STEP = 32  # words folded at a time in the running xor
MAPS = 8  # numbers of 64 bits that stand for the set of words of a long line


def _half(words: Column, side: str, length: Column) -> Column:
    part = F.slice(words, 1, length) if side == "first" else F.slice(words, F.size(words) - length + 1, length)
    return F.xxhash64(F.lit(side), part)


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Lines that have words, ``id, key, line_no, n, line, halves``."""
    rows = docs.select(column(doc_id).alias("id"), text_key(column(text)).alias("key"), column(text).cast("string").alias("text"))
    lines = rows.select("id", "key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "content"))
    lines = lines.select("id", "key", "line_no", spaced_words(F.col("content")).alias("words"))
    words, n = F.col("words"), F.size("words")
    short, long = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    halves = F.array_distinct(F.array(*[_half(words, side, length) for side in ("first", "last") for length in (short, long)]))
    halves = F.when(n >= MIN_WORDS - 1, halves).otherwise(F.array().cast("array<bigint>"))
    return lines.select("id", "key", "line_no", n.alias("n"), F.xxhash64("words").alias("line"), halves.alias("halves"))


def _folded(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def _neighbours(words: Column) -> Column:
    """``variant, at`` of a line: itself (at = -1), and without the word at each place."""
    here = F.transform(words, lambda w, i: F.xxhash64(w, i))
    moved = F.transform(words, lambda w, i: F.xxhash64(w, i - 1))

    def all_of(arrays: Column) -> Column:
        here, moved = arrays["here"], arrays["moved"]
        both = F.zip_with(here, moved, lambda a, b: a.bitwiseXOR(b))

        def of_steps(x: Column) -> Column:
            # Before the place: the words as they are; behind it: moved up by one.
            def variant(m: Column, i: Column) -> Column:
                done = F.floor(i / STEP).cast("int")
                before = F.get(x["sums"], done).bitwiseXOR(_folded(F.slice(x["both"], done * STEP + 1, i - done * STEP)))
                return F.struct(x["tail"].bitwiseXOR(before).bitwiseXOR(m).alias("variant"), i.alias("at"))

            own = F.array(F.struct(x["own"].alias("variant"), F.lit(-1).alias("at")))
            return F.concat(own, F.transform(moved, variant))

        def with_sums(x: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.size(x["steps"])), lambda k: _folded(F.slice(x["steps"], 1, k)))
            return F.struct(x["both"].alias("both"), x["own"].alias("own"), x["tail"].alias("tail"), sums.alias("sums"))

        starts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / STEP).cast("int"))
        steps = lambda b: F.transform(starts, lambda k: _folded(F.slice(b, k * STEP + 1, F.lit(STEP))))
        first = F.transform(F.array(both), lambda b: F.struct(b.alias("both"), steps(b).alias("steps"), _folded(here).alias("own"), _folded(moved).alias("tail")))
        return F.element_at(F.transform(F.transform(first, with_sums), of_steps), 1)

    # Transforms over one element name what is used at many places.
    return F.element_at(F.transform(F.array(F.struct(here.alias("here"), moved.alias("moved"))), all_of), 1)


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two lists of words differ by exactly one word put in, left out or replaced."""
    least = F.least(F.size(a), F.size(b))
    equal = F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda x, y: x == y)
    wrong = F.array_position(equal, False).cast("int")
    at = F.when(wrong > 0, wrong).otherwise(least + 1)  # from 1
    rest = lambda x, start: F.slice(x, start, F.greatest(F.size(x) - start + 1, F.lit(0)))
    same = (F.size(a) == F.size(b)) & (wrong > 0) & (rest(a, at + 1) == rest(b, at + 1))
    longer = (F.size(a) == F.size(b) + 1) & (rest(a, at + 1) == rest(b, at))
    shorter = (F.size(b) == F.size(a) + 1) & (rest(b, at + 1) == rest(a, at))
    return same | longer | shorter


def _worded(likely: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``line, n, order, words`` of lines ``line, n, first``, whose texts are read again."""
    place = likely.select("line", "n", F.col("first.id").alias("at_id"), F.col("first.key").alias("at_key"), F.col("first.line_no").alias("at_no"))
    rows = docs.select(column(doc_id).alias("id"), text_key(column(text)).alias("key"), column(text).cast("string").alias("text"))
    size = place.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("at_id").cast("string")), F.lit(0)) + 36), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        lines = rows.select("id", "key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "content"))
        there = lines["id"].eqNullSafe(place["at_id"]) & (lines["key"] == place["at_key"]) & (lines["line_no"] == place["at_no"])
        found = lines.join(F.broadcast(place), there).select("line", "n", "at_id", "at_key", "at_no", "content")
    else:
        listed = place.groupBy("at_id", "at_key").agg(F.collect_list(F.struct("line", "n", "at_no")).alias("wanted"))
        there = rows["id"].eqNullSafe(listed["at_id"]) & (rows["key"] == listed["at_key"])
        met = rows.join(listed, there).select("at_id", "at_key", F.split("text", "\n", -1).alias("lines"), F.explode("wanted").alias("w"))
        found = met.select("w.line", "w.n", "at_id", "at_key", "w.at_no", F.get("lines", F.col("w.at_no")).alias("content"))
    order = F.struct(F.col("at_id").alias("id"), F.col("at_key").alias("key"), F.col("at_no").alias("no"), "line", "n")
    return staged(found.select("line", "n", order.alias("order"), spaced_words(F.col("content")).alias("words")), "worded", compression="zstd")


def _partnered(kinds: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The lines ``line, n`` that have an earlier partner within one edit."""
    halves = kinds.select("line", F.explode("halves").alias("half"))
    common = halves.groupBy("half").agg(F.min("line").alias("low"), F.max("line").alias("high")).filter("low < high").select("half")
    likely = halves.join(common, "half").select("line").distinct()
    likely = staged(kinds.join(likely, "line", "left_semi").select("line", "n", "first"), "likely")
    worded = _worded(likely, docs, doc_id, text)

    near = worded.select("line", "n", "order", F.explode(_neighbours(F.col("words"))).alias("v"))
    near = staged(near.select("line", "n", "order", "v.variant", "v.at"), "neighbours")
    common = near.groupBy("variant").agg(F.min("line").alias("low"), F.max("line").alias("high")).filter("low < high").select("variant")
    near = staged(near.join(common, "variant"), "met")
    # The earliest of the lines that leave out the same place, of all that leave out any, and the whole line itself.
    places = near.groupBy("variant", "at").agg(F.min("order").alias("earliest"))
    wholes = places.filter("at < 0").select("variant", F.col("earliest").alias("other"))
    cut = places.filter("at >= 0").groupBy("variant").agg(F.min("earliest").alias("other"))
    asks = near.join(places, ["variant", "at"]).select("line", "n", "order", F.col("earliest").alias("other"))
    asks = asks.unionByName(near.filter("at >= 0").join(wholes, "variant").select("line", "n", "order", "other"))
    asks = asks.unionByName(near.filter("at < 0").join(cut, "variant").select("line", "n", "order", "other"))
    asks = asks.filter((F.col("other") < F.col("order")) & (F.greatest(F.col("n"), F.col("other.n")) >= MIN_WORDS))
    asks = asks.select("line", "n", F.col("other.line").alias("other_line"), F.col("other.n").alias("other_n")).distinct()
    one = worded.select("line", "n", "words").dropDuplicates(["line", "n"])
    other = one.select(F.col("line").alias("other_line"), F.col("n").alias("other_n"), F.col("words").alias("other_words"))
    verified = asks.join(one, ["line", "n"]).join(other, ["other_line", "other_n"]).filter(_one_edit(F.col("words"), F.col("other_words")))
    return verified.select("line", "n").distinct()


def _allowed(a: Column, b: Column) -> Column:
    """The edits between two long lines of that many words."""
    return F.floor(F.greatest(a, b) / EDIT_WORDS).cast("int")


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``line, n, marks, own`` of the lines that may have a partner with two edits or more; ``own`` are those of passages side by side."""
    lines = docs.select(F.explode(F.split(column(text).cast("string"), "\n", -1)).alias("content"))
    lines = lines.select(spaced_words(F.col("content")).alias("words"))
    words, n = F.col("words"), F.size("words")
    grams = F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.xxhash64(F.slice(words, i, GRAM)))
    starts = F.sequence(F.lit(1), n - PASSAGE + 1)
    # Transforms over one element name what is used at many places.
    least = lambda g: F.transform(starts, lambda i: F.array_min(F.slice(g, i, PASSAGE - GRAM + 1)))
    side_by_side = F.sequence(F.lit(0), F.floor(n / PASSAGE).cast("int") - 1)
    both = lambda m: F.struct(
        F.array_distinct(m).alias("marks"), F.array_distinct(F.transform(side_by_side, lambda k: F.get(m, k * PASSAGE))).alias("own")
    )
    found = F.element_at(F.transform(F.transform(F.array(grams), least), both), 1)
    long = lines.filter(n >= 2 * (EDIT_WORDS - 1))
    return long.select(F.xxhash64("words").alias("line"), n.alias("n"), found.alias("m")).select("line", "n", "m.marks", "m.own")


def _within(a: Column, b: Column, bound: Column) -> Column:
    """Whether two lists of words differ by ``bound`` words put in, left out or replaced, or fewer."""

    def close(x: Column) -> Column:
        # Each word of the pair is a character of its own, from the first plane beyond the surrogates on.
        letter = lambda w: F.lpad(F.hex(F.array_position(x["all"], w) + 0xFFFF), 8, "0")
        letters = lambda words: F.decode(F.unhex(F.array_join(F.transform(words, letter), "")), "UTF-32")
        return F.call_function("levenshtein", letters(x["a"]), letters(x["b"]), x["bound"]) >= 0

    pair = F.struct(a.alias("a"), b.alias("b"), bound.alias("bound"), F.array_distinct(F.concat(a, b)).alias("all"))
    few = (F.size(F.array_except(a, b)) <= bound) & (F.size(F.array_except(b, a)) <= bound)
    return few & F.element_at(F.transform(F.array(pair), close), 1)


def _words_of(places: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``line, n, words`` of the lines ``line, n, order``."""
    likely = staged(places.select("line", "n", F.col("order").alias("first")).distinct(), "likely")
    return _worded(likely, docs, doc_id, text).select("line", "n", "words").dropDuplicates(["line", "n"])


def _verified(asks: DataFrame, words: DataFrame) -> DataFrame:
    """The lines ``line, n`` of the pairs ``line, n, other_line, other_n`` that are within the grown bound."""
    other = words.select(F.col("line").alias("other_line"), F.col("n").alias("other_n"), F.col("words").alias("other_words"))
    met = asks.join(words, ["line", "n"]).join(other, ["other_line", "other_n"])
    return met.filter(_within(F.col("words"), F.col("other_words"), _allowed(F.col("n"), F.col("other_n")))).select("line", "n").distinct()


def _maps(words: Column) -> Column:
    """The set of words as bits."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    of = lambda k: F.filter(hashes, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(MAPS - 1)) == k)
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    bits = lambda k: F.aggregate(of(k), F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(bit(h)))
    return F.transform(F.sequence(F.lit(0), F.lit(MAPS - 1)), bits)


def _lacking(a: list[Column], b: list[Column]) -> Column:
    """How many bits of ``a`` are not in ``b``."""
    return sum((F.bit_count(x.bitwiseAND(F.bitwise_not(y))) for x, y in zip(a, b)), F.lit(0))


def _alike(left: DataFrame, others: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The lines ``line, n`` of ``left`` that are within the bound of any earlier line with one of the marks they ask by."""
    pool = staged(others.join(left.select("mark").distinct(), "mark", "left_semi").select("mark", "other.*"), "pool")
    words = staged(_words_of(left.select("line", "n", "order").unionByName(pool.select("line", "n", "order")), docs, doc_id, text), "words", compression="zstd")
    sets = staged(words.select("line", "n", _maps(F.col("words")).alias("maps")), "maps")
    sets = sets.select("line", "n", *(F.get("maps", F.lit(k)).alias(f"map{k}") for k in range(MAPS)))
    asking = left.join(sets, ["line", "n"])
    asked = pool.join(sets, ["line", "n"]).select(*(F.col(c).alias(c if c == "mark" else f"other_{c}") for c in [*pool.columns, *sets.columns[2:]]))
    own, theirs = ([F.col(f"{side}map{k}") for k in range(MAPS)] for side in ("", "other_"))
    bound = _allowed(F.col("n"), F.col("other_n"))
    apt = (F.col("other_order") < F.col("order")) & (bound >= 2) & (F.abs(F.col("n") - F.col("other_n")) <= bound)
    apt = apt & (_lacking(own, theirs) <= bound) & (_lacking(theirs, own) <= bound)
    pairs = asking.join(asked, (asking["mark"] == asked["mark"]) & apt).select("line", "n", "other_line", "other_n").distinct()
    return _verified(staged(pairs, "pairs"), words)


def _grown(kinds: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The lines ``line, n`` that have an earlier partner within a bound of two edits or more."""
    # No line is without marks; explode alone would have the optimizer make them once more, to filter by their number.
    marked = _marked(docs, doc_id, text)
    every = marked.select("line", F.explode_outer("marks").alias("mark"))
    common = every.groupBy("mark").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.count("*").alias("many"))
    common = staged(common.filter("low < high").select("mark", "many"), "common-marks")
    listed = F.broadcast(common) if common.count() * 16 <= BROADCAST_BYTES else common
    each = marked.select("line", "n", F.size("own").alias("n_own"), "own", F.explode_outer("marks").alias("mark"))
    each = each.select("line", "n", "n_own", "mark", F.array_contains("own", F.col("mark")).alias("is_own")).join(listed, "mark")
    each = each.dropDuplicates(["line", "n", "mark"])
    long = kinds.filter(F.col("n") >= 2 * (EDIT_WORDS - 1))
    each = staged(each.join(long.select("line", "n", F.col("first").alias("order")), ["line", "n"]), "marked")

    most = F.floor(F.col("n") / (EDIT_WORDS - 1)).cast("int")  # allowed with a longer partner
    shared = each.filter("is_own").groupBy("line", "n", "n_own", "order").agg(F.array_sort(F.collect_list(F.struct("many", "mark"))).alias("shared"))
    asked = F.slice("shared", 1, F.greatest(most + 1 - (F.col("n_own") - F.size("shared")), F.lit(0)))
    askers = staged(shared.select("line", "n", "order", F.explode(asked).alias("by")).select("line", "n", "order", "by.mark"), "askers")

    others = each.select("mark", F.struct(F.col("order"), "line", "n").alias("other"))
    bound = _allowed(F.col("n"), F.col("other.n"))
    apt = (F.col("other.order") < F.col("order")) & (bound >= 2) & (F.abs(F.col("n") - F.col("other.n")) <= bound)
    earliest = others.groupBy("mark").agg(F.min("other").alias("other"))
    asks = staged(askers.join(earliest, "mark").filter(apt).select("line", "n", "order", "other").distinct(), "asks")
    words = _words_of(asks.select("line", "n", "order").unionByName(asks.select("other.line", "other.n", "other.order")), docs, doc_id, text)
    asks = asks.select("line", "n", F.col("other.line").alias("other_line"), F.col("other.n").alias("other_n"))
    near = staged(_verified(asks, words), "near")
    left = staged(askers.join(near, ["line", "n"], "left_anti"), "left")
    return near.unionByName(_alike(left, others, docs, doc_id, text))


def line_fates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", grown: bool = False) -> DataFrame:
    """Per line with words ``id, key, line_no, copy`` (an equal line is earlier) and ``near`` (a similar line is)."""
    lines = staged(_lines(docs, doc_id, text).filter("n > 0"), "lines")
    kinds = lines.groupBy("line", "n").agg(F.min(F.struct("id", "key", "line_no")).alias("first"), F.first("halves").alias("halves"))
    kinds = staged(kinds, "kinds")
    near = _partnered(kinds.filter(F.size("halves") > 0), docs, doc_id, text)
    if grown:
        near = near.unionByName(_grown(kinds, docs, doc_id, text)).distinct()
    near = near.withColumn("near", F.lit(True))
    judged = kinds.select("line", "n", "first").join(near, ["line", "n"], "left")
    order = F.struct("id", "key", "line_no")
    found = lines.select("id", "key", "line_no", "line", "n").join(judged, ["line", "n"])
    return found.select("id", "key", "line_no", (~order.eqNullSafe(F.col("first"))).alias("copy"), F.coalesce("near", F.lit(False)).alias("near"))


def _dropped(docs: DataFrame, doc_id: str, text: str, grown: bool = False) -> DataFrame:
    """``id, key, copies, near``: the numbers of the lines that go, of the texts that lose any."""
    fates = line_fates(docs, doc_id, text, grown).filter("copy or near")
    copies = F.sort_array(F.collect_set(F.when(F.col("copy"), F.col("line_no")))).alias("copies")
    near = F.sort_array(F.collect_set(F.when(~F.col("copy"), F.col("line_no")))).alias("near")
    # A text has no more lines than bytes, so its lists are bounded by the text itself.
    return staged(fates.groupBy(F.col("id").alias("lost_id"), F.col("key").alias("lost_key")).agg(copies, near), "dropped")


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", grown: bool = False, emptied: bool = True) -> DataFrame:
    """All columns, the texts without the lines that are dropped; rows whose texts lose all words go unless ``emptied``."""
    lost = _dropped(docs, doc_id, text, grown).select("lost_id", "lost_key", F.array_union("copies", "near").alias("gone"))
    rows = wrapped(docs, column(doc_id).alias("id"), text_key(column(text)).alias("key"))
    joined = rows.join(lost, rows["id"].eqNullSafe(lost["lost_id"]) & (rows["key"] == lost["lost_key"]), "left")
    whole = F.col("row")[text]
    # The lines are made behind the join, which would shuffle every text twice; a transform over one element names them.
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    joined_again = lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n")
    rest = F.element_at(F.transform(F.array(F.split(whole, "\n", -1)), joined_again), 1)
    if not emptied:
        joined = joined.filter(F.col("gone").isNull() | rest.rlike(r"[^\x20\x09-\x0D]"))
    return joined.select(*(F.when(F.col("gone").isNull(), whole).otherwise(rest).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """Per document the lines it has, loses as copies, loses as near copies, and keeps, and a digest of the numbers kept."""
    lost = _dropped(docs, "doc_id", "text")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    same = rows["doc_id"].eqNullSafe(lost["lost_id"]) & (rows["key"] == lost["lost_key"])
    none = F.array().cast("array<int>")
    joined = rows.join(lost, same, "left").select("doc_id", "n_lines", F.coalesce("copies", none).alias("copies"), F.coalesce("near", none).alias("near"))
    numbers = F.when(F.col("n_lines") > 0, F.sequence(F.lit(0), F.col("n_lines") - 1)).otherwise(none)
    kept = F.array_except(numbers, F.array_union("copies", "near"))
    return joined.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("copies").cast("long").alias("n_copies"),
        F.size("near").cast("long").alias("n_near"),
        F.sha2(F.concat_ws(",", kept.cast("array<string>")), 256).alias("kept_sha256"),
    )
