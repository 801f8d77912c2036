"""The operators on texts against plain Python, and on odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ruleloom.llm import decontaminate, licenses, line_dedup, minhash, mixing, quality, suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(vocabulary)}" for _ in range(n))


# ---------------------------------------------------------------- decontamination


def test_contamination_marks_words_of_windows(documents, items, by_id):
    item = prose(1, 14, 10_000)
    texts = [f"x {item.upper()}, y", " ".join(item.split()[:9]), f"{item.split()[0]} " + " ".join(item.split()[:11]), "rare", "rare rare", None]
    found = by_id(decontaminate.report(documents(texts), items([item, "Rare!", "", None])))
    assert [found[i]["n_hit"] for i in range(6)] == [14, 0, 11, 1, 2, 0]
    assert [found[i]["contaminated"] for i in range(6)] == [True, False, True, True, True, False]
    assert found[0]["items_sha256"] == sha("0") and found[3]["items_sha256"] == sha("1") and found[5]["items_sha256"] == sha("")
    kept = decontaminate.decontaminated(documents(texts), items([item, "Rare!", "", None]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5] and kept.columns == documents(texts).columns


def test_contamination_in_blocks(documents, items, by_id, monkeypatch):
    texts = [prose(i, 60) for i in range(12)]
    wanted = [" ".join(t.split()[5:25]) for t in texts[::2]]
    whole = by_id(decontaminate.report(documents(texts), items(wanted)))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 500)
    assert by_id(decontaminate.report(documents(texts), items(wanted))) == whole
    assert [whole[i]["n_hit"] >= 20 for i in range(12)] == [True, False] * 6


def test_contamination_of_odd_rows(odd, items, documents):
    found = decontaminate.report(odd, items(["two three"]))
    assert sorted(r["n_hit"] for r in found.collect()) == [0] * 6 + [2] * 3
    assert decontaminate.report(odd, items([])).filter("contaminated").count() == 0
    assert decontaminate.report(documents([]), items(["two"])).count() == 0


# ---------------------------------------------------------------- line dedup


def test_texts_that_lose_all_words(documents):
    texts = ["one\ntwo", "two\n\n one", None, "", " \n", "two\nthree"]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(documents(texts), emptied=False).collect()}
    assert kept == {0: "one\ntwo", 2: None, 3: "", 4: " \n", 5: "three"}


def test_lines_within_one_word(documents, by_id):
    line = "a b c d e f g h i j"
    texts = [
        f"{line}\nshort one",
        line.replace("e", "x"),  # replaced
        line.replace(" e", ""),  # left out
        line.replace("e", "e e2"),  # put in
        line.replace("e", "x").replace("a", "y"),  # two words from the first, one from the second
        "short two\nshort one\n\n" + line,
        "a b c d e f g h z i j k",  # two words
    ]
    found = by_id(line_dedup.report(documents(texts)))
    assert [(found[i]["n_copies"], found[i]["n_near"]) for i in range(7)] == [(0, 0), (0, 1), (0, 1), (0, 1), (0, 1), (2, 0), (0, 0)]
    kept = by_id(line_dedup.cleaned(documents(texts)))
    assert kept[5]["text"] == "short two\n" and kept[1]["text"] == "" and kept[0]["text"] == texts[0] and kept[6]["key"] == "k"


def test_lines_by_a_shuffle(documents, by_id, monkeypatch):
    rng = random.Random(3)
    lines = [prose(i, rng.choice([8, 9, 40, 70])) for i in range(20)]
    texts = []
    for i in range(30):
        words = rng.choice(lines).split()
        words[rng.randrange(len(words))] = f"new{rng.randrange(3)}"
        texts.append("\n".join([" ".join(words), rng.choice(lines)]))
    found = by_id(line_dedup.report(documents(texts)))
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert by_id(line_dedup.report(documents(texts))) == found

    def near(a, b):
        if a == b:
            return True
        cut = lambda w: {tuple(w[:i] + w[i + 1 :]) for i in range(len(w))}
        same = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
        return max(len(a), len(b)) >= line_dedup.MIN_WORDS and (same or tuple(b) in cut(a) or tuple(a) in cut(b))

    seen = []
    for i, text in enumerate(texts):
        lost = [any(near(e, line.split()) for e in seen + [x.split() for x in text.split("\n")[:n]]) for n, line in enumerate(text.split("\n"))]
        seen += [x.split() for x in text.split("\n")]
        assert found[i]["n_copies"] + found[i]["n_near"] == sum(lost), i


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_the_bound_of_the_stage_grows_with_the_line(documents, by_id, spark):
    rng = random.Random(11)
    passage = prose(99, 25, 9_000)  # common, but not enough of a line
    bases = [prose(i, n, 9_000).split() for i, n in enumerate([12, 38, 39, 40, 41, 60, 100, 260])]
    lines = []
    for k in range(90):
        words = list(rng.choice(bases))
        for e in range(rng.randrange(len(words) // 20 + 3)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [f"n{k}-{e}"] * rng.randrange(2)
        lines.append(words)
    lines += [f"{prose(200 + i, 30, 9_000)} {passage}".split() for i in range(12)]
    rng.shuffle(lines)

    def near(a, b):
        n = max(len(a), len(b))
        return word_edits(a, b) <= (0 if n < line_dedup.MIN_WORDS else max(1, n // line_dedup.EDIT_WORDS))

    expected = [any(near(x, y) for y in lines[:i]) for i, x in enumerate(lines)]
    docs = documents([" ".join(x) for x in lines])
    found = by_id(line_dedup.cleaned(docs, grown=True))
    assert [found[i]["text"] == "" for i in range(len(lines))] == expected and 20 < sum(expected) < 80
    # In the pipeline a document that has lost all its lines goes.
    left = by_id(corpus_pipeline.drop_lines(spark, docs.withColumnRenamed("size", "n_chars"), ""))
    assert [i not in left for i in range(len(lines))] == expected


def test_grown_bound_of_odd_rows(odd, documents):
    assert line_dedup.cleaned(odd, grown=True).count() == 9 and line_dedup.cleaned(documents([]), grown=True).count() == 0
    # Longer by rare characters and by words that only look alike, with the last words of a text in a document of its own.
    words = [f"ü{i}𝒳" for i in range(80)]
    other = [w.upper() if i in (3, 30, 50, 70) else w for i, w in enumerate(words)]
    more = [*other[:20], "x", *other[20:]]
    found = line_dedup.cleaned(documents([" ".join(x) for x in (words, other, more)], ids=[None, 5, 6]), grown=True)
    assert sorted(r["text"] != "" for r in found.collect()) == [False, False, True]


def test_lines_of_odd_rows(odd, documents):
    rows = line_dedup.report(odd).collect()
    assert sum(r["n_copies"] for r in rows) == 1 and {r["n_lines"] for r in rows if r["doc_id"] == 2} == {2}
    assert line_dedup.cleaned(odd).count() == 9 and line_dedup.report(documents([])).count() == 0


# ---------------------------------------------------------------- near duplicates


def shingles(text):
    words = spaced((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def grouped(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_near_duplicates_equal_brute_force(documents, by_id):
    rng = random.Random(5)
    texts = []
    for i in range(60):
        words = prose(rng.randrange(6), rng.choice([4, 12, 30, 150])).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(100)}"
        texts.append(" ".join(words[: rng.choice([len(words), len(words) - 1])]))
    found = by_id(minhash.report(documents(texts)))
    assert [found[i]["component_id"] for i in range(60)] == grouped(texts)
    assert all(found[i]["n_shingles"] == len(shingles(t)) for i, t in enumerate(texts))
    assert minhash.deduplicated(documents(texts)).count() == len(set(grouped(texts)))


def test_a_chain_through_buckets_is_joined(documents, by_id, monkeypatch):
    base = prose(9, 120).split()
    chain = []
    for i in range(12):  # each links with the next ones alone
        words = list(base)
        words[: i * 3] = [f"c{k}" for k in range(i * 3)]
        chain.append(" ".join(words))
    monkeypatch.setattr(minhash, "FIRST_CENTRES", 1)
    found = by_id(minhash.report(documents(chain)))
    assert [found[i]["component_id"] for i in range(12)] == grouped(chain)


def test_the_stage_takes_near_copies_from_080_on(documents, by_id, spark):
    def pair(seed, n, changed):  # one run of words replaced in the middle
        words = prose(seed, n, 10**9).split()
        return [" ".join(words), " ".join(words[: n // 2] + [f"c{seed}-{k}" for k in range(changed)] + words[n // 2 + changed :])]

    texts = pair(20, 104, 6) + pair(21, 94, 5) + pair(22, 104, 8) + pair(23, 104, 2)
    sets = [shingles(t) for t in texts]
    assert [round(len(a & b) / len(a | b), 2) for a, b in zip(sets[::2], sets[1::2])] == [0.82, 0.82, 0.79, 0.89]
    kept = corpus_pipeline.keep_first_of_near(spark, documents(texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 5, 6]
    assert [r["kept"] for _, r in sorted(by_id(minhash.report(documents(texts))).items())] == [True] * 7 + [False]


def test_one_row_of_each_group_stays(documents):
    base = [prose(i, 60) for i in range(4)]
    near = base[0] + " more"
    texts = [base[0], near, base[1], None, "", base[2], base[2] + " more", base[3]]
    once = documents(texts, ids=[4, 2, 3, 5, 6, None, None, None])
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in minhash.deduplicated(once).collect())
    assert [i for i, _ in kept] == ["2", "3", "5", "6", "None", "None"] and ("None", base[3]) in kept
    appended = minhash.deduplicated(once.unionByName(once))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in appended.collect()) == kept and appended.columns == once.columns
    same_id = documents([base[0], near, base[1]], ids=[7, 7, 7])
    assert minhash.deduplicated(same_id).count() == 2


def test_near_duplicates_of_odd_rows(odd, documents):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.report(odd).collect()]
    assert len(rows) == 9 and rows.count((3, 1, 3, True)) == 2 and (4, 1, 3, False) in rows
    assert (0, 0, 0, True) in rows and (5, 59_996, 5, True) in rows and minhash.report(documents([])).count() == 0


# ---------------------------------------------------------------- licences


def test_licences(documents, by_id):
    texts = [
        "x Licensed under CC BY-NC 4.0. All rights reserved, all rights reserved",
        "This work is licensed under the GNU General Public License, version 3.",
        "released under the mit licence", "Released under the MIT License.", None, "general public",
    ]
    found = by_id(licenses.report(documents(texts)))
    assert [found[i]["labels"] for i in range(6)] == ["cc-by,cc-by-nc,reserved", "gpl,gpl-3.0", "", "mit", "", ""]
    assert [found[i]["base_labels"] for i in range(6)] == ["cc-by,reserved", "gpl", "", "", "", ""]
    assert (found[0]["n_base"], found[0]["first_word"], found[0]["last_word"], found[0]["n_words"]) == (3, 3, 11, 14)
    assert found[5]["first_word"] is None and found[4]["n_words"] == 0 and 0 < found[3]["score"] <= 1


def test_a_licence_without_its_rarest_words_is_found(documents, by_id):
    notice = next(words for label, words, _ in licenses.NOTICES if label == "cc0")
    text = notice.replace("extent", "scope").replace("possible", "feasible").replace("law", "statute")
    found = by_id(licenses.report(documents([text] + ["filler"] * 400)))
    assert found[0]["labels"] == "cc0" and 0.75 <= found[0]["score"] < 0.8 and found[1]["labels"] == ""


DRIFTING = (
    ("permission is hereby granted free of charge to any person or firm obtaining a copy of this software", "mit"),
    ("permission is hereby granted at no cost and free of charge to any person obtaining a copy of this software", "mit"),
    ("Redistribution and use in source form and binary forms, with or without modification, are permitted.", "bsd"),
    ("// SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("made available under the terms of the Eclipse Public License v2.0", "epl-2.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("the mandatory phrase alone, free of charge to any person", ""),
)


def test_licences_with_words_put_in(documents, by_id):
    found = by_id(licenses.report(documents([t for t, _ in DRIFTING] + ["filler"] * 400)))
    assert [found[i]["labels"] for i in range(len(DRIFTING))] == [label for _, label in DRIFTING]


def plain_notices(words, entries):
    """Labels and scores of a text: each notice tried at each place, a word at its place or near it."""
    found = set()
    for e in entries:
        for start in range(-len(e["notice"]), len(words)):
            at = lambda i: words[i] if 0 <= i < len(words) else None
            if not all(at(start + i) == e["notice"][i] for i in e["needed"]):
                continue
            total = 0.0
            for i, (word, weight) in enumerate(zip(e["notice"], e["weights"])):
                window = [at(start + i + k) for k in range(-licenses.DRIFT, licenses.DRIFT + 1)]
                total += weight * (1.0 if at(start + i) == word else licenses.DRIFTED if word in window else 0.0)
            if total / e["whole"] >= licenses.THRESHOLD:
                found.add((start, e["label"], round(min(total / e["whole"], 1.0), 9)))
    return found


def test_altered_notices_equal_brute_force(documents):
    rng, texts = random.Random(5), []
    for _, notice, _ in licenses.NOTICES:
        for _ in range(4):
            words = ["lead"] * rng.randint(0, 6) + notice.split() + ["rest"] * rng.randint(0, 3)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = rng.choice(([], ["new"], [words[0]]))
            texts.append(" ".join(words))
    docs = documents(texts)
    entries = licenses._index(docs.select(licenses.plain_words(docs["text"]).alias("words")), licenses.NOTICES)
    found = {r["id"]: {(p["at"], p["label"], round(p["score"], 9)) for p in r["notices"]} for r in licenses.scanned(docs).collect()}
    expected = [plain_notices(t.split(), entries) for t in texts]
    assert [found[i] for i in range(len(texts))] == expected and sum(map(bool, expected)) > len(texts) / 2


def test_licences_base_equals_brute_force(documents, by_id):
    rng, parts = random.Random(2), "cc by general public license all rights reserved BY CC x".split()
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(40)]
    found = by_id(licenses.report(documents(texts)))
    for i, text in enumerate(texts):
        words, places = plain(text), []
        for phrase, _ in licenses.BASE:
            p = phrase.split()
            places += [k for k in range(len(words)) if words[k : k + len(p)] == p]
        row = found[i]
        assert (row["n_words"], row["n_base"], row["first_word"]) == (len(words), len(places), min(places, default=None))


def test_licences_of_odd_rows(odd, documents):
    assert {r["labels"] for r in licenses.report(odd).collect()} == {""} and licenses.report(documents([])).count() == 0


# ---------------------------------------------------------------- quality


def test_quality_counts_equal_brute_force(documents, labels, by_id):
    rng = random.Random(4)
    texts = ["a b c d e a b c d e", "x y z", None, "", "#a $b%\nq\nq\n \n ", "of " * 50, "é è ü " * 9]
    texts += [" ".join(rng.choice("a b c".split()) for _ in range(rng.randrange(40))) for _ in range(30)]
    found = by_id(quality.report(documents(texts), labels([])))
    for i, text in enumerate(texts):
        words, text = spaced(text), text or ""
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        many = Counter(windows)
        covered = {p for k, w in enumerate(windows) if many[w] > 1 for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if spaced(x)]
        expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert tuple(found[i][c] for c in quality.COUNTS) == expected, text
        assert found[i]["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert found[i]["kept"] != found[i]["base_failed"]


def test_quality_learns_the_rejected_class(documents, labels, by_id):
    good = [prose(i, 40, 5_000) for i in range(150)]
    bad = [" ".join(w + "%%%" for w in prose(1000 + i, 40, 5_000).split()) for i in range(80)]
    docs = documents(good + bad)
    found = by_id(quality.report(docs, labels([(i, int(i < 150), 0) for i in range(0, 230, 2)])))
    assert [found[i]["kept"] for i in range(230)] == [True] * 150 + [False] * 80
    kept = quality.accepted(docs, labels([(i, int(i < 150), 0) for i in range(0, 230, 2)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(150)) and kept.columns == docs.columns


def test_quality_of_odd_rows(odd, documents, labels):
    odd_labels = labels([(0, 1, 0), (0, 0, 0), (None, 0, 0), (3, None, 0), (5, 1, 0)])
    assert {r["doc_id"] for r in quality.accepted(odd, odd_labels).collect()} == {5}
    assert quality.report(documents([]), odd_labels).count() == 0


# ---------------------------------------------------------------- suffix arrays


def cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    many = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if many[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("hot", [0, 1500])
def test_suffix_dedup_equals_brute_force(documents, by_id, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "GRAM", 8)
    rng = random.Random(8)
    texts = ["ab" * 200, "é" * 90, None, "", "x" * 49, "x" * 51]
    for _ in range(40):
        parts = [prose(rng.randrange(8), rng.randrange(3, 30)) for _ in range(rng.randrange(1, 5))]
        texts.append(f"{rng.random()}".join(parts))
    found = {r["id"]: r for r in suffix_dedup.cut_out(documents(texts), length=50).collect()}
    expected = cut(texts, 50)
    assert [bytes(found[i]["kept"]) for i in range(len(texts))] == expected
    assert all(found[i]["kept_sha256"] == hashlib.sha256(e).hexdigest() for i, e in enumerate(expected))


def test_suffix_dedup_of_a_very_long_text(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    monkeypatch.setattr(suffix_dedup.K, "SLICE", 500)
    texts = [prose(1, 2_000, 9_000), prose(2, 300) + prose(1, 2_000, 9_000)[3000:5000]]
    found = sorted(suffix_dedup.cut_out(documents(texts)).collect(), key=lambda r: r["id"])
    assert [bytes(r["kept"]) for r in found] == cut(texts, 400)


def test_passages_below_the_length_stay(documents):
    """Texts may share an anchor without any string of 400 bytes, so that a shard has nothing to report."""
    shared = prose(1, 60, 9_000)[:399]
    texts = [f"{prose(2 * i + 2, 80, 9_000)} {i}{shared}{i} {prose(2 * i + 3, 80, 9_000)}" for i in range(2)]
    assert {r["n_removed"] for r in suffix_dedup.report(documents(texts)).collect()} == {0}
    texts = [t.replace(shared, shared + "#") for t in texts]
    assert [r["n_removed"] for r in suffix_dedup.report(documents(texts)).collect()] == [400, 400]


def test_suffix_dedup_of_odd_rows(odd, documents):
    rows = suffix_dedup.report(odd).collect()
    assert len(rows) == 9 and sum(r["n_removed"] for r in rows) == 0 and suffix_dedup.report(documents([])).count() == 0
    twice = documents(["abc " * 200, "abc " * 200], ids=[1, 1])
    assert [r["n_removed"] for r in suffix_dedup.report(twice).collect()] == [800, 800]


def test_segments_of_a_frequent_anchor_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", 100)
    placed = spark.createDataFrame([(i, 0, 7 if i % 2 else i, i, 0) for i in range(2000)], "id long, key long, anchor long, segment long, start long")
    repeated = spark.createDataFrame([(7, True, 10), (4, False, 1)], "anchor long, differs boolean, parts long")
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in zip(names, ("false", "-1")):
            spark.conf.set(name, value)
        rows = suffix_dedup._met(placed, repeated).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted((r["anchor"], r["segment"], r["differs"]) for r in rows) == sorted([(4, 4, False), *((7, i, True) for i in range(1, 2000, 2))])
    assert len({r["task"] for r in rows if r["anchor"] == 7}) > 1


def test_suffix_dedup_of_a_split_anchor_equals_brute_force(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", 2)
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "GRAM", 8)
    common = prose(1, 12)
    texts = [f"{i} {common} {prose(i % 5, 20)}" for i in range(20)] + [common * 3] * 2
    found = sorted(suffix_dedup.cut_out(documents(texts), length=50).collect(), key=lambda r: r["id"])
    assert [bytes(r["kept"]) for r in found] == cut(texts, 50)


# ---------------------------------------------------------------- mixing


def shares(sizes, weights, most=3.0):
    """Targets, by filling up until no source is above its limit."""
    open_, target = set(range(len(sizes))), [0.0] * len(sizes)
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            return target
        for i in over:
            target[i] = most * sizes[i]
        left, open_ = left - sum(target[i] for i in over), open_ - over
    return target


def test_mix_meets_targets(documents):
    rng = random.Random(6)
    sources = [rng.choice(["b", "a", "c", "c", "c", "c", "é", None]) for _ in range(1500)]
    texts = [prose(i, rng.randrange(1, 40)) if s != "b" or i < 60 else None for i, s in enumerate(sources)]
    rows = mixing.report(documents(texts, sources=sources)).collect()
    names = ["a", "b", "c", "é", None]
    sizes = [sum(len(spaced(t)) for t, s in zip(texts, sources) if s == n) for n in names]
    for name, size, target in zip(names, sizes, shares(sizes, [1, 2, 3, 1, 2])):
        own = [r for r in rows if r["source"] == name]
        assert {r["source_size"] for r in own} == {size} and own[0]["target"] == pytest.approx(target)
        assert abs(sum(r["taken"] for r in own) - target) <= 20
        assert all(r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in own)
    assert len(rows) == 1500
    again = mixing.report(documents(texts, sources=sources).repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_mix_of_odd_rows(odd, documents):
    rows = mixing.report(odd).collect()
    assert len(rows) == 9 and sum(r["source_size"] is None for r in rows) == 0
    assert mixing.report(documents([])).count() == 0
    same = mixing.report(documents(["a b"] * 400 + ["c"], ids=[7] * 400 + [8], sources=["x"] * 400 + ["y"]))
    assert same.count() == 401 and abs(same.groupBy().sum("taken").first()[0] - 801) <= 2



def test_lines_are_not_shuffled_beside_their_texts(documents):
    rows = documents(["a b\nc d\na b", "a b", None])
    plan = line_dedup.cleaned(rows, grown=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "split(" not in plan[plan.index("Join ") :]
    assert {r["doc_id"]: r["text"] for r in line_dedup.cleaned(rows, grown=True).collect()} == {0: "a b\nc d", 1: "", 2: None}
