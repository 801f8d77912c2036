"""Toxicity by non-negative positive-unlabelled learning.

The positives are texts confirmed as toxic; everything else is unlabelled text, in which toxic texts hide with the
class prior. A linear classifier over hashed words and byte stretches is trained by numpy on the risk

    prior * R+(positive)  +  max(0, R-(unlabelled) - prior * R-(positive))

whose second term is held at zero or above: where a step would drive it below, the step goes the other way.

The classifier is fitted on at most about ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` unlabelled texts, drawn by
a hash of the id. The prior is the share of toxic labels among the labelled training rows, or ``PRIOR``.

Defined results: null and empty texts have no features and get the score of an empty text; ids that are null, and
null labels, teach nothing; several labels of an id count by their greatest; without positives every score is 0;
repeated rows get the same score; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.llm import tokens as K
from ruleloom.llm.common import bounded, column, id_bucket

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_POSITIVE, MAX_UNLABELLED = 2_000, 8_000
PRIOR = 0.1
LIMIT = 0.3  # predicted toxic from this score on
BITS = 18
STRETCH = 4  # bytes, inside words
MIN_SUPPORT = 4  # positives that a feature has to occur in
MIN_LIFT, MIN_EXCESS = 2.5, 5.0  # how much more frequent it is there, and in standard deviations of chance
MAX_FEATURES = 2_000
EPOCHS, STEP, DECAY = 150, 0.05, 1e-3


def _features(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts at a time: how many they are, and the text number and feature of each different feature.

    Features are words, and the stretches of bytes inside words; with ``weights`` those of weight 0 are left out.
    """
    shift, size = np.uint64(64 - BITS), 2 << BITS
    for first, last in K.slices(offsets):
        bounds = offsets[first : last + 1]
        words, n = K.word_hashes(data, bounds)
        part, local = K.LOWERED[data[bounds[0] : bounds[-1]]], bounds - bounds[0]
        owners, found = [np.repeat(np.arange(last - first), n)], [(words >> shift).astype(np.int64)]
        if len(part) >= STRETCH:
            code = np.zeros(len(part) - STRETCH + 1, np.uint64)
            clean = np.ones(len(part), bool)
            for k in range(STRETCH):
                here = part[k : len(code) + k]
                code = code * np.uint64(257) + here
                clean[: len(code)] &= K.SPACE_FREE[here]
            for k in range(1, STRETCH):  # a stretch ends with its text
                clean[np.maximum(local[1:] - k, 0)] = False
            clean = clean[: len(code)]
            owners.append(np.repeat(np.arange(last - first), np.diff(local))[: len(code)][clean])
            found.append((K.mix(code[clean]) >> shift).astype(np.int64) + (1 << BITS))
        owner, feature = np.concatenate(owners), np.concatenate(found)
        if weights is not None:
            known = weights[feature] != 0
            owner, feature = owner[known], feature[known]
        both = np.unique(owner * size + feature)
        yield last - first, both // size, both % size


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for n, owner, feature in _features(*K.byte_column(batch.column("text"))):
            ends = np.searchsorted(owner, np.arange(n + 1))
            rows += [feature[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("positive"), pa.array(rows, pa.binary())], names=["id", "positive", "features"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers, their weights and the intercept."""
    size = 2 << BITS
    support = np.zeros(size, np.int64)
    for found in positive:
        support[found] += 1
    spread = np.zeros(size, np.int64)
    for found in unlabelled:
        spread[found] += 1
    share, common = (support + 0.5) / (len(positive) + 1), (spread + 0.5) / (len(unlabelled) + 1)
    excess = (support - len(positive) * common) / np.sqrt(len(positive) * common * (1 - common))
    marked = (support >= MIN_SUPPORT) & (share >= MIN_LIFT * common) & (excess >= MIN_EXCESS)
    chosen = np.sort(np.argsort(np.where(marked, -excess, np.inf), kind="stable")[: min(MAX_FEATURES, int(marked.sum()))])
    number = np.full(size, -1, np.int64)
    number[chosen] = np.arange(len(chosen))

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(chosen) + 1), np.float32)
        out[:, -1] = 1
        for i, found in enumerate(rows):
            out[i, number[found][number[found] >= 0]] = 1
        return out

    p, u = matrix(positive), matrix(unlabelled)
    weights = np.zeros(len(chosen) + 1, np.float32)
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, EPOCHS + 1):
        sp, su = _sigmoid(p @ weights), _sigmoid(u @ weights)
        # Logistic losses: -log s for toxic, -log(1 - s) for clean.
        clean_risk = -np.log1p(-np.minimum(su, 1 - 1e-7)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-7)).mean()
        toxic_grad = prior * ((sp - 1) @ p) / len(p)
        clean_grad = (su @ u) / len(u) - prior * (sp @ p) / len(p)
        grad = toxic_grad + clean_grad if clean_risk >= 0 else -clean_grad
        grad = grad + DECAY * weights * np.append(np.ones(len(chosen), np.float32), 0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        weights = weights - STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return chosen, weights[:-1].astype(float), float(weights[-1])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic"):
    """The model from ``id, text`` and the labels; ``held_out`` is a column of ``id``."""
    known = labels.select(column("doc_id").alias("label_id"), column(label).alias("toxic")).filter("label_id is not null and toxic in (0, 1)")
    known = known.withColumnRenamed("label_id", "id").filter(~held_out).groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("all"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not counts["toxic"]:
        return None
    prior = min(max(counts["toxic"] / counts["all"], 0.01), 0.5) if counts["toxic"] < counts["all"] else PRIOR
    positive = bounded(known.filter("toxic = 1").select("id"), F.col("id"), MAX_POSITIVE, counts["toxic"])
    open_rows = docs.filter(F.col("id").isNotNull()).filter(~held_out)
    unlabelled = bounded(open_rows, F.col("id"), MAX_UNLABELLED, open_rows.count()).withColumn("positive", F.lit(False))
    # The positives are bounded in number, so they are broadcast.
    confirmed = open_rows.join(F.broadcast(positive), "id").withColumn("positive", F.lit(True))
    schema = T.StructType([docs.schema["id"], T.StructField("positive", T.BooleanType()), T.StructField("features", T.BinaryType())])
    sets: dict[bool, list] = {True: [], False: []}
    for row in confirmed.unionByName(unlabelled).select("id", "positive", "text").mapInArrow(_featured, schema).toLocalIterator():
        sets[row["positive"]].append((row["id"], np.frombuffer(bytes(row["features"]), np.int32)))
    ordered = {k: [f for _, f in sorted(v, key=lambda x: (x[0], len(x[1]), x[1].tobytes()))] for k, v in sets.items()}
    return train(ordered[True], ordered[False], prior) if ordered[True] and ordered[False] else None


def _rated(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = np.zeros(2 << BITS), -30.0
        if model is not None:
            weights[model[0]], intercept = model[1], model[2]
        for batch in batches:
            sums = [np.zeros(0)]
            for n, owner, feature in _features(*K.byte_column(batch.column("text")), weights):
                sums.append(np.bincount(owner, weights[feature], minlength=n))
            scores = _sigmoid(np.concatenate(sums) + intercept)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores)], names=["id", "held_out", "score"])

    return run


def rated(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``id, held_out, score``."""
    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("text"))
    held_out = id_bucket(F.col("id"), modulus) == held
    model = fit(rows, labels, held_out)
    schema = T.StructType([rows.schema["id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return rows.select("id", held_out.alias("held_out"), "text").mapInArrow(_rated(model), schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = rated(docs, labels)
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
