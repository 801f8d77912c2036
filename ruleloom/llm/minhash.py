"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A text is the set of its five-word shingles (64-bit hashes). One hash per shingle fills ``BINS`` bins by its upper bits,
the least of a bin is its value, and an empty bin takes that of the first filled one on a fixed random tour of its
own. Bands of a few bins are the buckets (``BANDS``, ``ROWS``). Equal sets are folded into one node before anything is
paired.

Candidates are stars: each member of a bucket meets one centre, not each other. Links are confirmed on the full sets,
and joined to components. Where a bucket still spans several components, further centres are drawn, eight times as many
each round, and meet the members of other components whose size and shared shingles allow a link, until all pairs that
could join two components are settled. So no link of a bucket is lost, while a group of near copies costs about one
pair a member.

Linked are pairs from a similarity on that the caller gives in hundredths, ``SIMILAR`` unless told otherwise. A pair of
0.85 shares no bucket with a probability of (1 - 0.85**5)**25; below that, bands are shorter and more, and a pair of 0.80
shares none with (1 - 0.80**4)**32. Both are less than one in a million.

Defined results: null, empty and blank texts have no shingles and link with nothing; a text of fewer than five words
is one shingle; repeated rows and equal texts are one component; the representative is the least id, null ids last;
an empty table gives no rows; further columns are kept by ``deduplicated``. That leaves one row of each component, by
(id, text key), and one of the rows that agree in id and text, also where the text has no shingles.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.llm import tokens as K
from ruleloom.llm.common import column, one_of_each, text_key, without
from ruleloom.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
BINS, BANDS, ROWS = 128, 25, 5
WIDE_BANDS, WIDE_ROWS = 32, 4  # for similarities below SIMILAR/OF
SIMILAR, OF = 85, 100  # linked from SIMILAR/OF on, unless the caller gives another similarity
FIRST_CENTRES = 1024
BROADCAST_LINKS = 1_000_000  # pairs of numbers, 16 MB
_rng = np.random.default_rng(7)
TOURS = np.array([_rng.permutation(BINS) for _ in range(BINS)])
ROW_FACTORS = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
BAND_SEEDS = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
SHINGLE_FACTORS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
BAND_SEEDS = np.concatenate([BAND_SEEDS, _rng.integers(1, 1 << 63, WIDE_BANDS - BANDS, dtype=np.uint64)])


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text."""
    if not len(words):
        return words
    length = min(size, len(words))
    n = len(words) - length + 1
    total = np.full(n, np.uint64(length), np.uint64)
    for k in range(length):
        total += words[k : k + n] * SHINGLE_FACTORS[k]
    return np.unique(K.mix(total))


def layout(similar: int) -> tuple[int, int]:
    """Bands, and bins of a band, that lose less than one in a million of the pairs as similar as that."""
    return (BANDS, ROWS) if similar >= SIMILAR else (WIDE_BANDS, WIDE_ROWS)


def signature(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band hashes of a sorted set."""
    bins = (shingles >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    filled, values = np.zeros(BINS, bool), np.zeros(BINS, np.uint64)
    filled[bins[first]], values[bins[first]] = True, shingles[first]
    if len(first) < BINS:
        donors = TOURS[np.arange(BINS), filled[TOURS].argmax(axis=1)]
        values = np.where(filled, values, values[donors])
    cells = values[: bands * rows].reshape(bands, rows)
    return K.mix((K.mix(cells) * ROW_FACTORS[:rows]).sum(axis=1, dtype=np.uint64) + BAND_SEEDS[:bands])


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = K.byte_column(batch.column("text"))
    for first, last in K.slices(offsets):
        hashes, counts = K.word_hashes(data, offsets[first : last + 1])
        ends = np.cumsum(counts)
        for begin, end in zip(ends - counts, ends):
            yield shingle_set(hashes[begin:end])


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(id_type: T.DataType, n_bands: int, n_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, bands = [], [], []
            for found in _sets(batch):
                sizes.append(len(found))
                nodes.append(_node(found) if len(found) else None)
                bands.append(K.as_long(signature(found, n_bands, n_rows)) if len(found) else None)
            arrays = [batch.column("id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "key", "n", "node", "bands"])

    return run


def _node_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [K.as_long(found) for found in _sets(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def signatures(docs: DataFrame, doc_id: str, text: str, similar: int = SIMILAR) -> DataFrame:
    """``id, key, n, node, bands`` per row; rows of one node have the same set."""
    rows = docs.select(column(doc_id).alias("id"), text_key(column(text)).alias("key"), column(text).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )
    return rows.mapInArrow(_signed(id_type, *layout(similar)), schema)


def _small(rows: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(rows) if few else rows


def _stars(edges: DataFrame, few: bool) -> DataFrame:
    """One large star and one small star: all neighbours of a node move to its least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.filter("v > u").join(_small(least, few), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    hops = large.join(_small(least, few), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hops.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Links ``a, b`` to ``node, root``, the least node reachable, by alternating large and small stars."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), name)
    while True:
        # Few links are numbers of a known size, and are broadcast; more of them are joined by shuffles.
        few = edges.count() <= BROADCAST_LINKS
        parents = _small(edges.select(F.col("v").alias("u")).distinct(), few)
        hanging = edges.join(parents, "u", "left_semi").select("u")
        twice = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        if hanging.unionByName(twice).isEmpty():  # each node has one parent, and no parent has one
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = staged(_stars(edges, few), name)


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs ``a, b`` of nodes whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return met.filter(OF * common >= similar * union).select("a", "b")


def _shared_sizes(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, common``: how many of a node's shingles occur in any other of these nodes.

    No pair of them can have more in common, which settles most pairs before they are formed: of two copies with
    edits of their own, each has shingles that nobody shares.
    """
    parts = sets.join(rest.select("node").distinct(), "node", "left_semi").select("node", F.explode("shingles").alias("s"))
    kept = parts.groupBy("s").agg(F.min("node").alias("node"), F.count("*").alias("n")).filter("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    sizes = rest.select("node", "n").distinct()
    return sizes.join(kept, "node", "left").select("node", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """Per row ``id, key, n, component``: the least id of the rows it is linked with, directly or not.

    ``component_key`` is the text key of that row; of rows with this id, or of rows without ids, the least. Linked are rows of a similarity of ``similar`` hundredths or more.
    """
    if not 80 <= similar <= OF:
        raise ValueError("the bands are laid out for similarities of 80 to 100 hundredths")
    rows = staged(signatures(docs, doc_id, text, similar), "signatures")
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("least"))
    one = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.first("bands").alias("bands"), F.first("n").alias("n"))
    buckets = one.select("node", "n", F.posexplode("bands").alias("band", "hash"))
    buckets = buckets.select("node", "n", "band", F.xxhash64("band", "hash").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = staged(buckets.join(shared, "bucket"), "members")

    # Only nodes that share a bucket need their full set; one text of each is read again.
    wanted = members.select("node").distinct()
    banded = staged(one.join(wanted, "node", "left_semi").select("node", "bands"), "banded")
    chosen = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "key")).alias("row"))
    chosen = chosen.select("node", F.col("row.id").alias("row_id"), F.col("row.key").alias("row_key"))
    texts = docs.select(column(doc_id).alias("id"), text_key(column(text)).alias("key"), column(text).cast("string").alias("text"))
    same = texts["id"].eqNullSafe(chosen["row_id"]) & (texts["key"] == chosen["row_key"])
    texts = texts.join(chosen, same).select("node", "text")
    sets = staged(texts.mapInArrow(_node_sets, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    # The centre of a bucket is the member that meets most others: of a text and its copies, most likely the text.
    meets = members.groupBy("node").agg(F.sum("size").alias("meets"))
    middle = members.join(meets, "node").groupBy("bucket").agg(F.max(F.struct("meets", "node", "n")).alias("c"))
    members = staged(members.join(middle.select("bucket", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")), "bucket"), "members")
    near = (OF * F.least("n", "centre_n") >= similar * F.greatest("n", "centre_n")) & (F.col("node") != F.col("centre"))
    stars = members.filter(near).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = staged(_confirmed(stars, sets, similar), "links")
    roots = components(links)
    rest = members.filter("node != centre").select("bucket", "band", "node", "n")
    centres = FIRST_CENTRES
    while True:
        rest = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_buckets = rest.groupBy("bucket").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
        slices = F.ceil(F.col("size") / centres)
        rest = rest.join(open_buckets.filter("low < high").select("bucket", "size"), "bucket")
        rest = staged(rest.withColumn("is_centre", F.pmod(F.xxhash64("node", "bucket", F.lit(centres)), slices) == 0), "rest")
        if rest.isEmpty():
            break
        for _ in range(2):  # what the first pass drops makes more shingles unshared
            sizes = _shared_sizes(rest, sets)
            rest = rest.drop("common").join(sizes, "node").filter(OF * F.col("common") >= similar * F.col("n"))
        rest = staged(rest.join(banded, "node"), "rest")
        drawn = rest.filter("is_centre").select(
            "bucket", F.col("node").alias("a"), F.col("n").alias("an"), F.col("root").alias("ar"), F.col("common").alias("ac"), F.col("bands").alias("ab")
        )
        most = F.least("common", "ac")
        near = (F.col("root") != F.col("ar")) & (OF * most >= similar * (F.col("n") + F.col("an") - most))
        # Of two centres the smaller asks, and of the buckets that two nodes share the first, so that a pair is tried once.
        near = near & (~F.col("is_centre") | (F.col("node") > F.col("a")))
        first_shared = F.array_position(F.zip_with("bands", "ab", lambda x, y: x == y), True) == F.col("band") + 1
        pairs = rest.join(drawn, "bucket").filter(near & first_shared).select("a", F.col("node").alias("b")).distinct()
        found = staged(_confirmed(pairs, sets, similar), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)
        rest, centres = rest.filter("not is_centre").select("bucket", "band", "node", "n"), centres * 8

    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("head"))
    placed = rooted.join(heads, "root").select("node", F.col("head.id").alias("component"), F.col("head.key").alias("component_key"))
    plain = rows.filter(F.col("node").isNull()).select("id", "key", "n", F.col("id").alias("component"), F.col("key").alias("component_key"))
    return rows.filter(F.col("node").isNotNull()).join(placed, "node").select(*plain.columns).unionByName(plain)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """One document of each group, the one with the least id, with all its columns."""
    found = staged(near_duplicates(docs, doc_id, text, similar), "found")
    first = F.col("id").eqNullSafe(F.col("component")) & (F.col("key") == F.col("component_key"))
    names = [F.col("id").alias("gone_id"), F.col("key").alias("gone_key")]
    gone = found.filter(~first).select(*names).distinct()
    # Rows that the name doesn't tell apart are taken out, and one of each name is put back.
    twice = staged(found.filter(first).groupBy("id", "key").agg(F.count("*").alias("rows")).filter("rows > 1").select(*names), "twice")
    kept = without(docs, staged(gone.unionByName(twice), "copies"), doc_id, text)
    if twice.isEmpty():
        return kept
    return kept.unionByName(one_of_each(docs, twice, doc_id, text))


def report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )
