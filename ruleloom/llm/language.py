"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword of bits; a bit is predicted by a binary classifier that tells the languages with that bit
from those without it, by the log-odds of hashed byte n-grams. The decoder takes the codeword of least weighted loss:
a bit counts by its weight (how well it tells languages apart) times the exponential loss of its margin. A text whose
two best codewords are nearly equal is flagged as ambiguous.

All labelled training texts are counted (per language and n-gram bucket, summed by Spark); only these sums, of a size
fixed by the number of languages and ``BUCKETS``, come to the driver, and only the weights go to the tasks.

Defined results: a null text, or one without a letter, is ``und`` with score 0; null languages are not learned; with
one known language every other text has it, with none all are ``und``; repeated rows count each; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.llm import tokens as K
from ruleloom.llm.common import column, id_bucket

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 12
GRAMS = (2, 3, 4)  # bytes of an n-gram
EXTRA_BITS = 8  # beside one bit per language
AMBIGUOUS = 0.6  # a score below it is flagged
SHARPNESS = 40.0  # of the score, in losses
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def _buckets(part: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that start at each byte."""
    wide = K.LOWERED[part].astype(np.uint32)
    found = []
    for n in GRAMS:
        if len(wide) < n:
            continue
        code = np.full(len(wide) - n + 1, np.uint32(n), np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) ^ wide[k : len(wide) - n + 1 + k]
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append((code >> np.uint32(20)).astype(np.int64))
    return found


def _counts(part: np.ndarray) -> np.ndarray:
    total = np.zeros(BUCKETS)
    for start in range(0, len(part), K.SLICE):  # slices overlap, so that no n-gram is lost; the last bytes of each pad it
        end = min(start + K.SLICE, len(part))
        for n, codes in zip(GRAMS, _buckets(part[start : min(end + max(GRAMS) - 1, len(part))])):
            total += np.bincount(codes[: min(end, len(part) - n + 1) - start], minlength=BUCKETS)
    return total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language of a batch, the counts of all buckets."""
    for batch in batches:
        data, offsets = K.byte_column(batch.column("text"))
        totals: dict[str, np.ndarray] = {}
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            found = _counts(data[offsets[i] : offsets[i + 1]])
            totals[lang] = totals[lang] + found if lang in totals else found
        langs = list(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array([totals[x].tolist() for x in langs], pa.list_(pa.float64()))], names=["lang", "counts"]
        )


def codewords(languages: int) -> np.ndarray:
    """A row of bits per language: its own bit, and fixed random ones that split the languages in halves."""
    own = np.eye(languages, dtype=bool)
    rng = np.random.default_rng(languages)
    extra = []
    for _ in range(EXTRA_BITS if languages > 2 else 0):
        bits = np.zeros(languages, bool)
        bits[rng.permutation(languages)[: languages // 2]] = True
        extra.append(bits)
    return np.column_stack([own, *extra]) if extra else own


def fit(texts: DataFrame) -> dict:
    """The model from ``text, lang``: languages, codewords, and per bit n-gram weights and a bit weight."""
    sums = texts.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").mapInArrow(_sums, "lang string, counts array<double>")
    spread = sums.select("lang", F.posexplode("counts").alias("bucket", "n")).filter("n > 0")
    rows = spread.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # languages x BUCKETS at most
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(langs), BUCKETS))
    place = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        counts[place[r["lang"]], r["bucket"]] = r["n"]
    codes = codewords(len(langs))
    # Languages count alike, however much text they have.
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if langs else counts
    weights, useful = [], []
    for bit in codes.T:
        yes = shares[bit].mean(axis=0) if bit.any() else np.full(BUCKETS, 1 / BUCKETS)
        no = shares[~bit].mean(axis=0) if (~bit).any() else np.full(BUCKETS, 1 / BUCKETS)
        odds = np.log(yes) - np.log(no)
        weights.append(odds)
        useful.append(float(((yes - no) * odds).sum()))
    return {"langs": langs, "codes": codes, "weights": np.array(weights).reshape(-1, BUCKETS), "useful": np.array(useful)}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The best language and its score from the mean margins of the bits (one row per text)."""
    signs = np.where(model["codes"], 1.0, -1.0)
    weight = model["useful"] / max(model["useful"].sum(), 1e-12)
    loss = np.array([(weight * np.exp(-np.clip(margins * s, -20, 20))).sum(axis=1) for s in signs]).T
    spread = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
    best = loss.argmin(axis=1)
    return best, spread.max(axis=1) / spread.sum(axis=1)


def _predicted(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.byte_column(batch.column("text"))
            n = batch.num_rows
            has_letter = np.array([LETTER.search(t or "") is not None for t in batch.column("text").to_pylist()], bool)
            langs, scores = np.full(n, UNKNOWN, object), np.zeros(n)
            rows = np.flatnonzero(has_letter)
            if len(rows) and model["langs"]:
                margins = np.zeros((len(rows), len(model["weights"])))
                for k, i in enumerate(rows):
                    found = _counts(data[offsets[i] : offsets[i + 1]])
                    margins[k] = model["weights"] @ found / max(found.sum(), 1.0)
                best, score = decode(margins, model)
                langs[rows], scores[rows] = np.array(model["langs"], object)[best], score
            arrays = [batch.column("id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores), pa.array((scores < AMBIGUOUS) | ~has_letter)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def identified(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row ``id, held_out, lang_pred, score, ambiguous``, learned from the rows that are not held out."""
    rows = docs.select(
        column(doc_id).alias("id"), column(text).cast("string").alias("text"), column(lang).cast("string").alias("lang"),
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
    )
    model = fit(rows.filter(~F.col("held_out")))
    schema = T.StructType(
        [rows.schema["id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    )
    return rows.select("id", "text", "held_out").mapInArrow(_predicted(model), schema)


def report(docs: DataFrame) -> DataFrame:
    return identified(docs, id_bucket(F.col("doc_id"), 4) == 2).withColumnRenamed("id", "doc_id")
