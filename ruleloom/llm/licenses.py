"""Licence scans with a positional rare-token index.

The index holds the words of licence notices with their places. A word's weight is its rarity in the corpus (IDF), and
a notice is looked up by the rarest word of its mandatory phrase, which any notice that counts must have: wherever a
file has it, the word's place in the notice gives the only possible start, and the postings of the whole notice are
intersected with the file at that relative position. A word that stands up to ``DRIFT`` places off, since words were put
in or left out between, counts ``DRIFTED`` of its weight. The score is the weight of the words that agree. A notice
counts if the score reaches ``THRESHOLD`` and its mandatory phrase agrees word for word.

Beside it, the base phrases are looked for at every place.

The index is a small constant, so that a text is scanned in its row, without a join or a shuffle.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows are scanned alike; notices
that repeat count once as a label; of equally rare words of a phrase the first is looked up; a text of any length is
scanned whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import column, plain_words

THRESHOLD = 0.75
DRIFT, DRIFTED = 4, 0.9

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Label, notice, and the phrase of it that must be there.
NOTICES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "with or without modification"),
    ("bsd", "the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "commons attribution noncommercial 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "commons attribution sharealike 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived all copyright"),
    ("epl-2.0", "made available under the terms of the eclipse public license v 2 0", "eclipse public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     "gnu general public license as published"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "for any purpose with or without fee"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
     "gnu lesser general public license as published"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("public-domain", "has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law",
     "dedicated the work to the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "the authors be held liable"),
)

# Label, and the words of its tag after "SPDX-License-Identifier:".
TAGS = (
    ("agpl-3.0", "agpl 3 0"), ("apache-2.0", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("cc-by", "cc by 4 0"),
    ("cc-by-nc", "cc by nc 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc0", "cc0 1 0"), ("epl-2.0", "epl 2 0"), ("gpl-2.0", "gpl 2 0"),
    ("gpl-3.0", "gpl 3 0"), ("isc", "isc"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("mit", "mit"), ("mpl-2.0", "mpl 2 0"),
    ("unlicense", "unlicense"), ("zlib", "zlib"),
)
NOTICES += tuple((label, f"spdx license identifier {tag}", f"spdx license identifier {tag}") for label, tag in TAGS)


def _phrase_places(words: Column, parts: list[str], label: str) -> Column:
    starts = F.filter(
        F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: _all([F.get(words, i + k) == p for k, p in enumerate(parts)])
    )
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def base_places(words: Column) -> Column:
    """Starts of all base phrases, as an array of ``at, label``."""
    nothing = F.array().cast("array<struct<at:bigint,label:string>>")
    found = []
    for phrase, label in BASE:
        parts = phrase.split()
        likely = _all([F.array_contains(words, p) for p in parts]) & (F.size(words) >= len(parts))
        found.append(F.when(likely, _phrase_places(words, parts, label)).otherwise(nothing))
    return F.concat(*found)


def _all(tests) -> Column:
    whole = None
    for test in tests:
        whole = test if whole is None else whole & test
    return whole


def _index(worded: DataFrame, notices) -> list[dict]:
    """One entry per notice, under the rarest word of its phrase, with the weights of the notice's words and the places that must agree."""
    spark = worded.sparkSession
    vocabulary = sorted({w for _, notice, _ in notices for w in notice.split()})
    # The vocabulary is that of the notices, so its size doesn't follow the data.
    known = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    listed = F.array(*[F.lit(w) for w in vocabulary])
    met = worded.filter(F.arrays_overlap("words", listed)).select(F.explode(F.array_distinct("words")).alias("word"))
    seen = {r["word"]: r["n"] for r in met.join(known, "word").groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = worded.count()
    entries = []
    for label, notice, phrase in notices:
        words, needed = notice.split(), phrase.split()
        weights = [math.log((total + 1) / (seen.get(w, 0) + 1)) + 1e-6 for w in words]
        first = next(i for i in range(len(words)) if words[i : i + len(needed)] == needed)
        shared = {"label": label, "notice": words, "weights": weights, "whole": sum(weights), "needed": list(range(first, first + len(needed)))}
        offset = min(shared["needed"], key=lambda i: (-weights[i], i))
        entries.append({"word": words[offset], "offset": offset, **shared})
    return entries


ENTRY = "array<struct<word:string,offset:int,label:string,notice:array<string>,weights:array<double>,whole:double,needed:array<int>>>"


def _places_found(words: Column, entries: list[dict]) -> Column:
    """``at, label, score`` of the notices of one text; the index is a constant of the expression."""
    index = F.from_json(F.lit(json.dumps(entries)), ENTRY)
    anchors = sorted({e["word"] for e in entries})
    rare = F.array(*[F.lit(w) for w in anchors])
    places = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda p: F.array_contains(rare, p["word"]))

    def met(place: Column) -> Column:
        def compared(e: Column) -> Column:
            start = place["at"] - e["offset"]
            # A place before the text's start or beyond its end agrees with nothing.
            there = F.transform(e["notice"], lambda w, i: F.coalesce(F.get(words, start + i) == w, F.lit(False)))
            steps = F.array(*[F.lit(k) for k in range(-DRIFT, DRIFT + 1)])
            near = F.transform(e["notice"], lambda w, i: F.exists(steps, lambda k: F.coalesce(F.get(words, start + i + k) == w, F.lit(False))))
            shares = F.zip_with(there, near, lambda t, n: F.when(t, 1.0).when(n, DRIFTED).otherwise(0.0))
            agreed = F.aggregate(F.zip_with(shares, e["weights"], lambda share, w: share * w), F.lit(0.0), lambda a, b: a + b)
            certain = F.forall(e["needed"], lambda i: F.get(there, i))
            score = F.when(certain, F.least(agreed / e["whole"], F.lit(1.0))).otherwise(0.0)
            return F.struct(start.cast("long").alias("at"), e["label"].alias("label"), score.alias("score"))

        postings = F.filter(index, lambda e: e["word"] == place["word"])
        return F.filter(F.transform(postings, compared), lambda s: s["score"] >= THRESHOLD)

    found = F.array_distinct(F.flatten(F.transform(places, met)))
    return F.when(F.arrays_overlap(words, rare), found).otherwise(F.array().cast("array<struct<at:bigint,label:string,score:double>>"))


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices=NOTICES) -> DataFrame:
    """Per document ``id, n_words``, the ``places`` of base phrases, and the ``notices`` found (``at, label, score``)."""
    words = docs.select(column(doc_id).alias("id"), plain_words(column(text)).alias("words"))
    entries = _index(words, notices)
    return words.select(
        "id", F.size("words").cast("long").alias("n_words"), base_places(F.col("words")).alias("places"), _places_found(F.col("words"), entries).alias("notices")
    )


def report(docs: DataFrame) -> DataFrame:
    found = scanned(docs.select("doc_id", "text"))
    starts = F.transform("places", lambda p: p["at"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    base_score = F.when(F.size("places") > 0, 1.0).otherwise(0.0)
    labels = F.transform("notices", lambda p: p["label"])
    score = F.coalesce(F.array_max(F.transform("notices", lambda p: p["score"])), F.lit(0.0))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, labels))).alias("labels"),
        F.greatest(base_score, score).alias("score"),
    )
