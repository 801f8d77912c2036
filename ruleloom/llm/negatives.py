"""Hard negatives of anchors among all vectors, found by rotated one-bit codes and scored by integers.

1. A vector's components become whole numbers. Its direction is rotated by signs and Hadamard steps, and coded by the
   signs of the result: one bit a component. The alignment, the inner product of the direction with its code, is stored.
   What the code leaves is orthogonal to it, and is coded the same way; there are ``LEVELS`` codes in a row.
2. An anchor is rotated too, and each component taken as a number of ``BITS`` bits. Its inner product with a code is a
   sum of population counts of the code with the planes of those bits, and off by no more than the rounding.
3. Alignments times these products estimate a score. By Cauchy and Schwarz the error is at most the length of what the
   codes leave times that of the anchor; after the first code alone, of what the anchor has beyond that code. So the
   true score lies in an interval for certain. A row whose interval cannot reach what an anchor still takes leaves; the
   levels are tried one after the other, and what survives is scored exactly.
4. Anchors come in blocks of ``BLOCK_BYTES`` that go to the tasks, which scan all rows: once for the positives, and once
   for the negatives in the range that each positive sets. A task keeps no more than the best few of each anchor or
   positive and sends them at its end; a window then takes the best of all tasks. No pair becomes a row before that.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part; rows that
share an id count once, with the least label and then vector; shorter vectors are filled up with zeros; ties go to the
smaller id; an anchor without another row of its label gives no rows, and so does an empty table; further columns are
ignored. Scores have to fit a long.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import column
from ruleloom.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS = 256  # to the unit of a component
LEVELS, BITS = 4, 8
BLOCK_BYTES = 32 << 20  # of anchors that go to the tasks together
ROWS, ANCHORS = 2048, 512  # vectors and anchors that are compared at a time
FEW = 16  # one in so many pairs left: no further code is tried
NONE = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, with whole numbers as components."""
    numbers = column(vector).cast("array<double>")
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.select(column(vec_id).cast("long").alias("vec_id"), column(label).cast("long").alias("label"), numbers.alias("numbers"), fine.alias("fine"))
    own = own.filter("vec_id is not null and label is not null and fine")
    vectors = own.select("vec_id", "label", F.transform("numbers", lambda x: F.floor(x * STEPS)).alias("vector"))
    return vectors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


def _signs(width: int) -> np.ndarray:
    return np.random.default_rng(width).choice([-1.0, 1.0], (3, width))


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Rows turned by three rounds of signs and a Hadamard transform, all of them orthogonal."""
    n, width = vectors.shape
    out = vectors
    for signs in _signs(width):
        out = out * signs
        half = 1
        while half < width:
            pairs = out.reshape(n, width // (2 * half), 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
            half *= 2
        out = out / np.sqrt(width)
    return out


def _width(dimensions: int) -> int:
    return max(64, 1 << max(dimensions - 1, 0).bit_length())


def _filled(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows of a matrix."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def coded_directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Length of each row, and by level the codes, their alignments, and the length of what they leave of a unit vector."""
    n, width = vectors.shape
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    left = rotated(vectors / np.maximum(length, 1e-300)[:, None])
    codes, aligned, rest = np.empty((n, LEVELS, width // 64), np.uint64), np.empty((n, LEVELS)), np.empty((n, LEVELS))
    for level in range(LEVELS):
        up = left >= 0
        codes[:, level] = np.packbits(up, axis=1).view(np.uint64)
        aligned[:, level] = np.abs(left).sum(axis=1) / np.sqrt(width)
        left = left - aligned[:, level, None] * np.where(up, 1.0, -1.0) / np.sqrt(width)
        rest[:, level] = np.sqrt((left**2).sum(axis=1))
    return length, codes, aligned, rest


def _coding(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, codes, aligned, rest = coded_directions(_filled(batch.column("vector"), width))
            listed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), LEVELS).cast(pa.list_(pa.float64()))
            raw = [row.tobytes() for row in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("vector"), pa.array(length), pa.array(raw, pa.binary()), listed(aligned), listed(rest)],
                names=["vec_id", "label", "vector", "length", "codes", "aligned", "rest"],
            )

    return run


class _Rows:
    """Coded vectors of a batch."""

    def __init__(self, batch, width: int):
        number = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        lists = lambda name: batch.column(name).flatten().to_numpy().reshape(-1, LEVELS)
        self.vec_id, self.label, self.length = number("vec_id"), number("label"), number("length")
        self.aligned, self.rest = lists("aligned"), lists("rest")
        self.vectors = _filled(batch.column("vector"), width)
        self.codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint64).reshape(len(self.vec_id), LEVELS, width // 64)


class Anchors:
    """Vectors that ask, with the planes of their rotated components."""

    def __init__(self, vec_id: np.ndarray, label: np.ndarray, vectors: np.ndarray):
        self.vec_id, self.label, self.vectors = vec_id, label, vectors
        turned = rotated(vectors.astype(np.float64))
        self.width = vectors.shape[1]
        self.length = np.sqrt((turned**2).sum(axis=1))
        self.low = turned.min(axis=1, initial=0.0)
        self.step = np.maximum(turned.max(axis=1, initial=0.0) - self.low, 1e-300) / ((1 << BITS) - 1)
        taken = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        rounded = self.low[:, None] + taken * self.step[:, None]
        self.total, self.off = rounded.sum(axis=1), np.abs(turned - rounded).sum(axis=1) / np.sqrt(self.width)
        self.planes = np.stack([np.packbits((taken >> b & 1).astype(bool), axis=1).view(np.uint64) for b in range(BITS)], axis=1)

    def products(self, codes: np.ndarray, at: slice) -> np.ndarray:
        """Inner products of unit codes with rounded anchors, rows by anchors, by population counts."""
        counted = np.zeros((len(codes), self.planes[at].shape[0]), np.int32)
        for word in range(codes.shape[1]):
            for bit in range(BITS):
                counted += np.bitwise_count(codes[:, word, None] & self.planes[None, at, bit, word]).astype(np.int32) << bit
        ones = np.bitwise_count(codes).sum(axis=1)
        inside = self.low[at] * ones[:, None] + self.step[at] * counted
        return (2 * inside - self.total[at]) / np.sqrt(self.width)


def survivors(rows: _Rows, anchors: Anchors, mine: np.ndarray, at: slice, least: np.ndarray, most: np.ndarray, apt: np.ndarray):
    """Pairs (row, anchor) that are ``apt`` and whose score may lie between the least and the most an anchor takes."""
    length, size = rows.length[mine, None], anchors.length[at]
    estimate, error, open_ = 0.0, 0.0, apt
    slack = 1.0 + 1e-9 * length * size
    for level in range(LEVELS):
        product = anchors.products(rows.codes[mine, level], at)
        aligned, rest = rows.aligned[mine, level, None], rows.rest[mine, level, None]
        estimate = estimate + aligned * product
        error = error + aligned * anchors.off[at]
        beyond = size
        if level == 0:  # what is left is orthogonal to the code, so the anchor's part along the code does not count
            beyond = np.sqrt(np.maximum(size**2 - np.maximum(np.abs(product) - anchors.off[at], 0.0) ** 2, 0.0))
        wide = length * (error + rest * beyond) + slack
        open_ = open_ & (length * estimate + wide >= least) & (length * estimate - wide <= most)
        if np.count_nonzero(open_) * FEW <= open_.size:
            break
    return np.nonzero(open_)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _best(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, most: int):
    """Places of the ``most`` best of each group, highest score and then smallest id first, and their ranks from 0."""
    order = np.lexsort((vec_id, -score, group))
    sorted_ = group[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return order[rank < most], rank[rank < most]


class _Kept:
    """The best few of each group that a task has met."""

    def __init__(self, groups: int, most: int):
        self.most, self.least = most, np.full(groups, NONE)  # the score that a further one has to reach
        self.group, self.score, self.vec_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        if not len(group):
            return
        all_of = [np.concatenate(pair) for pair in ((self.group, group), (self.score, score), (self.vec_id, vec_id))]
        at, rank = _best(*all_of, self.most)
        self.group, self.score, self.vec_id = (x[at] for x in all_of)
        full = rank == self.most - 1
        self.least[self.group[full]] = self.score[full]


def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Rows]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield _Rows(batch.slice(start, ROWS), width)


def _parts(total: int) -> Iterator[slice]:
    for start in range(0, total, ANCHORS):
        yield slice(start, min(start + ANCHORS, total))


def _positives(block, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(*block.value)  # sorted by label
        kept = _Kept(len(anchors.vec_id), most)
        for rows in _each(batches, anchors.width):
            for label in np.unique(rows.label):
                mine = np.flatnonzero(rows.label == label)
                low, high = np.searchsorted(anchors.label, [label, label + 1])
                for part in _parts(high - low):
                    at = slice(low + part.start, low + part.stop)
                    least = kept.least[at]
                    other = rows.vec_id[mine, None] != anchors.vec_id[at]
                    i, j = survivors(rows, anchors, mine, at, least, np.inf, other)
                    score = _scores(rows.vectors[mine[i]], anchors.vectors[at][j])
                    good = score >= least[j]
                    kept.add(j[good] + at.start, score[good], rows.vec_id[mine[i[good]]])
        yield pa.RecordBatch.from_arrays([pa.array(anchors.vec_id[kept.group]), pa.array(kept.vec_id), pa.array(kept.score)], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(block, asked, most: int, shares: tuple[int, int]):
    low_share, high_share = shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(*block.value)
        anchor, positive_id, positive_score = asked.value  # sorted by anchor
        low = -(-low_share * positive_score // 100)  # the least and the most whole score in the range
        high = high_share * positive_score // 100
        first = np.searchsorted(anchor, np.arange(len(anchors.vec_id) + 1))
        kept = _Kept(len(anchor), most)
        for rows in _each(batches, anchors.width):
            mine = np.arange(len(rows.vec_id))
            for at in _parts(len(anchors.vec_id)):
                groups = slice(first[at.start], first[at.stop])
                if groups.start == groups.stop:
                    continue
                owner = anchor[groups] - at.start
                need = np.maximum(low[groups], kept.least[groups])
                # An anchor takes from the least that one of its positives needs to the most that one allows.
                least, upper = np.full(at.stop - at.start, np.inf), np.full(at.stop - at.start, -np.inf)
                np.minimum.at(least, owner, need)
                np.maximum.at(upper, owner, high[groups])
                i, j = survivors(rows, anchors, mine, at, least, upper, rows.label[:, None] != anchors.label[at])
                score = _scores(rows.vectors[i], anchors.vectors[at][j])
                good = (score >= least[j]) & (score <= upper[j])
                i, j, score = i[good], j[good], score[good]
                for rank in range(int(np.diff(first[at.start : at.stop + 1]).max())):
                    group = first[at.start + j] + rank
                    has = group < first[at.start + j + 1]
                    g, s, r = group[has], score[has], i[has]
                    fits = (s >= np.maximum(low[g], kept.least[g])) & (s <= high[g])
                    kept.add(g[fits], s[fits], rows.vec_id[r[fits]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (anchors.vec_id[anchor[kept.group]], positive_id[kept.group], kept.vec_id, positive_score[kept.group], kept.score)],
            names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
        )

    return run


def _first(rows: DataFrame, by: list[str], score: str, vec_id: str, most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), vec_id)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mined(vectors: DataFrame, anchor: str, positives: int = 5, negatives: int = 3, shares: tuple[int, int] = (50, 95)) -> DataFrame:
    """For anchors (rows of ``vec_id, label, vector`` that meet a condition) and each of their positives the negatives.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; the score of a negative is
    between the two shares, in hundredths, of the positive's.
    """
    sc = vectors.sparkSession.sparkContext
    vectors = staged(vectors, "vectors")
    dimensions = vectors.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    width = _width(dimensions)
    kinds = "vec_id long, label long, vector array<long>, length double, codes binary, aligned array<double>, rest array<double>"
    coded = staged(vectors.mapInArrow(_coding(width), kinds), "coded")
    asking = coded.filter(anchor).select("vec_id", "label", "vector")
    blocks = max(1, -(-asking.count() * (width * 8 * 2 + 64) // BLOCK_BYTES))
    found = []
    for number in range(blocks):
        block = asking.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).orderBy("label", "vec_id").toArrow()
        shipped = (block.column("vec_id").to_numpy(), block.column("label").to_numpy(), _filled(block.column("vector").combine_chunks(), width))
        sent = sc.broadcast(shipped)  # BLOCK_BYTES, about
        near = coded.mapInArrow(_positives(sent, positives), "anchor_id long, positive_id long, positive_score long")
        near = _first(near, ["anchor_id"], "positive_score", "positive_id", positives).select("anchor_id", "positive_id", "positive_score").toArrow()
        place = {int(v): i for i, v in enumerate(shipped[0])}
        owner = np.array([place[v] for v in near.column("anchor_id").to_pylist()], np.int64)
        order = np.argsort(owner, kind="stable")
        asked = sc.broadcast((owner[order], near.column("positive_id").to_numpy()[order], near.column("positive_score").to_numpy()[order]))
        names = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
        hard = coded.mapInArrow(_negatives(sent, asked, negatives, shares), names)
        found.append(staged(_first(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives), "negatives"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def report(embeddings: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    own = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    return mined(whole_vectors(own.withColumn("label", label)), "vec_id % 50 = 0")
