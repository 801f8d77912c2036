"""Benchmark decontamination: a prefix-filtered set join of documents with the windows of benchmark items.

An item is cut into windows of ``window`` words (one shorter window if it has fewer). The tokens of a window are its
word shingles; as *all* of them must occur in a document, the prefix of a window is one token, the rarest in the corpus.
Documents meet windows by that token alone; the token's place gives the only possible start (positional bound), the
window has to end inside the document (length bound), and the words are then compared one by one.

Defined results: a null or empty text has no words and is clean; an item without words has no windows; repeated items
count once; rows that agree in id and text get the same row each; an empty benchmark marks nothing; further columns
are ignored by ``contamination`` and kept by ``decontaminated``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import PLAIN_WORD, column, plain_words, text_key, without
from ruleloom.session import staged

SHINGLE = 3  # words of a token
BROADCAST_BYTES = 32 << 20  # windows of one pass; more windows are searched for in further passes
ROW_BYTES = 64


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """One row per item and different window: ``item, words``."""
    words = items.select(column(item_id).cast("string").alias("item"), plain_words(column(text)).alias("all"))
    size = F.size("all")
    starts = F.sequence(F.lit(1), F.greatest(size - window + 1, F.lit(1)))
    parts = F.transform(starts, lambda s: F.slice(F.col("all"), s, F.least(size, F.lit(window))))
    return words.filter(size > 0).select("item", F.explode(F.array_distinct(parts)).alias("words")).distinct()


def _shingle(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, at + i) for i in range(length)])


def _token_places(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """The tokens of each document, with their place; the words stay beside them, nothing is copied."""
    placed = docs.select("*", F.posexplode("words").alias("at", "word"))
    tokens = [F.struct(_shingle(F.col("words"), F.col("at"), n).alias("token"), F.lit(n).alias("n")) for n in lengths]
    if len(tokens) == 1:
        placed = placed.select("*", tokens[0].alias("t"))
    else:
        placed = placed.select("*", F.explode(F.array(*tokens)).alias("t"))
    return placed.filter(F.col("at") + F.col("t.n") <= F.size("words")).select(
        *docs.columns, "at", F.col("t.token").alias("token")
    )


def _prefixes(docs: DataFrame, windows: DataFrame, lengths: list[int], blocks: int) -> DataFrame:
    """Each window with its rarest token and that token's place; windows with a token no document has are gone."""
    size = F.size("words")
    length = F.least(size, F.lit(SHINGLE))
    token = F.coalesce(*[F.when(length == n, _shingle(F.col("words"), F.col("at"), n)) for n in lengths])
    placed = windows.select("wid", "words", F.explode(F.sequence(F.lit(0), size - length)).alias("at"))
    placed = placed.select("wid", "at", token.alias("token"))
    wanted = placed.select("token").distinct()
    counts = []
    for block in range(blocks):
        part = wanted.filter(F.pmod("token", F.lit(blocks)) == block)
        places = _token_places(docs.select("words"), lengths).select("token")
        counts.append(places.join(F.broadcast(part), "token").groupBy("token").agg(F.count("*").alias("n")))
    counted = staged(reduce(DataFrame.unionByName, counts), "tokens")
    ranked = placed.join(counted, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("wid").agg(F.min(F.struct("n", "token", "at")).alias("rare"))
    rarest = rarest.filter(F.col("rare.n") > 0).select("wid", F.col("rare.token").alias("token"), F.col("rare.at").alias("offset"))
    return windows.join(rarest, "wid")


def occurrences(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int):
    """Places of windows in documents ``id, key, start, length, wid``, and the items of each window ``wid, item``."""
    spark = docs.sparkSession
    owned = item_windows(items, item_id, item_text, window)
    owned = staged(owned.withColumn("wid", F.xxhash64(F.concat_ws(" ", "words"))), "windows")
    windows = owned.select("wid", "words").distinct()
    worded = docs.select(column(doc_id).alias("id"), text_key(column(text)).alias("key"), plain_words(column(text)).alias("words"))
    size = F.sum(F.octet_length(F.concat_ws(" ", "words")) + ROW_BYTES)
    known = windows.agg(size.alias("size"), F.collect_set(F.least(F.size("words"), F.lit(SHINGLE))).alias("lengths")).first()
    if not known["lengths"]:
        empty = spark.createDataFrame([], "key long, start int, length int, wid long")
        return docs.select(column(doc_id).alias("id")).limit(0).join(empty, F.lit(False)), owned.select("wid", "item")
    lengths, blocks = sorted(known["lengths"]), max(1, -(-known["size"] // BROADCAST_BYTES))
    prefixed = staged(_prefixes(worded, windows, lengths, blocks), "prefixes").withColumnRenamed("words", "window")
    found = []
    for block in range(blocks):
        part = prefixed.filter(F.pmod("wid", F.lit(blocks)) == block)
        met = _token_places(worded, lengths).join(F.broadcast(part), "token")
        start = F.col("at") - F.col("offset")
        inside = (start >= 0) & (start + F.size("window") <= F.size("words"))
        same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window")
        found.append(
            met.filter(inside).filter(same).select("id", "key", start.alias("start"), F.size("window").alias("length"), "wid")
        )
    return reduce(DataFrame.unionByName, found), owned.select("wid", "item")


def _covered(spans: Column) -> Column:
    """Words covered by spans in the order of their starts."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(state: Column, span: Column) -> Column:
        end = F.greatest(state["end"], span["end"])
        return F.struct((state["n"] + end - F.greatest(state["end"], F.least(span["start"], end))).alias("n"), end.alias("end"))

    return F.aggregate(spans, zero, step, lambda state: state["n"])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
) -> DataFrame:
    """Per document ``id, key, n_words, n_hit, items`` (``key`` is the text key of the row)."""
    places, owners = occurrences(docs, items, doc_id, text, item_id, item_text, window)
    places = staged(places, "occurrences")
    span = F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("length")).cast("long").alias("end"))
    hits = places.groupBy("id", "key").agg(_covered(F.sort_array(F.collect_set(span))).alias("n_hit"))
    named = places.select("id", "key", "wid").distinct().join(owners, "wid").groupBy("id", "key")
    found = hits.alias("h").join(
        named.agg(F.sort_array(F.collect_set("item")).alias("items")).alias("i"),
        F.col("h.id").eqNullSafe(F.col("i.id")) & (F.col("h.key") == F.col("i.key")),
    ).select(F.col("h.id").alias("hit_id"), F.col("h.key").alias("hit_key"), "n_hit", "items")
    n_words = F.regexp_count(F.coalesce(column(text), F.lit("")), F.lit(PLAIN_WORD))
    base = docs.select(column(doc_id).alias("id"), text_key(column(text)).alias("key"), n_words.cast("long").alias("n_words"))
    same = base["id"].eqNullSafe(found["hit_id"]) & (base["key"] == found["hit_key"])
    return base.join(found, same, "left").select(
        "id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    places, _ = occurrences(docs, items, doc_id, text, names.get("item_id", "item_id"), names.get("item_text", "text"), names.get("window", 10))
    gone = staged(places.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")).distinct(), "contaminated")
    return without(docs, gone, doc_id, text)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of the registered query."""
    found = contamination(docs, items)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
