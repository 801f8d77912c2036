"""SentencePiece encoding and decoding against the library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from ruleloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "   ", "▁", "a", "b", "the", "ing", "\n", "\t", "é", "中", "😀", "1", "23", "<s>", "</s>", " ", "\x00", "　", "!", "�"]


@pytest.fixture(scope="module")
def whole():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)

    def run(text):
        ids = model.encode(text or "", add_bos=True, add_eos=True)
        return ids, model.decode(ids)

    return run


def digests(found):
    ids, text = found
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def texts(n):
    rng = random.Random(3)
    return [None, "", " ", "  ", "▁", "\n"] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("held", [64 << 20, 3000, 0])
def test_encodes_as_the_library_does(documents, by_id, whole, monkeypatch, held):
    monkeypatch.setattr(pieces, "TABLE_BYTES", held)
    rows = texts(400)
    found = by_id(pieces.report(documents(rows).repartition(3), PATH))
    assert [(f["n_tokens"], f["ids_sha256"], f["decoded_sha256"]) for f in (found[i] for i in range(len(rows)))] == [digests(whole(t)) for t in rows]


def test_lists_and_texts(documents, whole):
    rows = texts(100)
    found = {r["id"]: r for r in pieces.encoded(documents(rows), pieces.read_model(PATH)).collect()}
    for i, text in enumerate(rows):
        assert (found[i]["ids"], found[i]["decoded"]) == whole(text)


def test_very_long_texts_and_chunks(documents, by_id, whole, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 1 << 12)
    rng = random.Random(4)
    rows = ["x" * 30_000, " ".join(f"w{rng.randrange(500)}" for _ in range(20_000)), " " * 20_000 + "z " * 9_000, "▁ é" * 5_000]
    found = by_id(pieces.report(documents(rows), PATH))
    assert [(f["n_tokens"], f["ids_sha256"], f["decoded_sha256"]) for f in (found[i] for i in range(4))] == [digests(whole(t)) for t in rows]


def test_ids_of_any_kind_decode(spark, whole):
    lists = [[1, 6312, 28709, 2], [], None, [195, 3], [0, 259, 264]]
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = spark.createDataFrame(list(enumerate(lists)), "id int, ids array<int>")
    found = {r["id"]: r["decoded"] for r in pieces.decoded(rows, pieces.read_model(PATH)).collect()}
    assert [found[i] for i in range(5)] == [model.decode(x or []) for x in lists]


def test_two_bodies_with_one_hash(monkeypatch):
    monkeypatch.setattr(pieces, "_hashes", lambda part, low, high: (high - low).astype(np.uint64))
    table = pieces._Table(pa.table({"body": ["the", "a"], "ids": [b"\1\0\0\0"] * 2}))
    row, known = table.found(np.frombuffer(b"thexyza", np.uint8), np.array([0, 3, 6]), np.array([3, 6, 7]))
    assert known.tolist() == [True, False, True] and table.size[row[0]] == 3


def test_odd_rows_and_an_empty_table(odd, documents):
    assert sorted(r["n_tokens"] for r in pieces.report(odd, PATH).collect())[:3] == [2, 2, 2]
    assert pieces.report(odd, PATH).count() == odd.count()
    assert pieces.report(documents([]), PATH).count() == 0


def test_a_table_is_hashed_in_slices(monkeypatch):
    """Hashing takes many times the bytes of a slice, and keeps powers for the longest one."""
    monkeypatch.setattr(pieces.K, "_powers", {})
    bodies = [f"{i:08d}" * 100 for i in range(4000)]
    table = pieces._Table(pa.table({"body": bodies, "ids": [b"\1\0\0\0"] * len(bodies)}))
    assert len(pieces.K._powers["up"]) <= 2 * pieces.K.SLICE < len("".join(bodies))
    part = np.frombuffer("".join(bodies[-2:]).encode(), np.uint8)
    assert table.found(part, np.array([0, 800]), np.array([800, 1600]))[1].all() and len(table.hashes) == len(bodies)
