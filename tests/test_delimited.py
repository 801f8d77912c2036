"""CSV through splits of a few bytes, against the standard library."""

import csv
import io
import random

import pytest

from ruleloom.sources import delimited as D
from ruleloom.sources import sinks as K
from ruleloom.sources import tables as C

VALUES = [" lead", "trail ", "\ttab\t", "end\n", "  ", "end\r", "\rx", "a\r\nb", "a\rb", 'q"q', '"', '""', "a,b", "", None, "\n", "\r\n", "x\n\ny\\", "#c", "ü", "a" * 70]


@pytest.fixture
def split_at(spark):
    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [1 << 27, 11, 40])
def test_values_come_back_as_written(spark, tmp_path, split_at, size):
    df = spark.createDataFrame([(str(i), v, v) for i, v in enumerate(VALUES)], "i string, v string, w string").coalesce(1)
    K.write_table(df, str(tmp_path / "o"), "csv")
    split_at(size)
    rows = C.read_csv(spark, str(tmp_path / "o")).orderBy("_row_idx").collect()
    assert [(int(r["i"]), r["v"], r["w"]) for r in rows] == [(i, v, v) for i, v in enumerate(VALUES)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [20, 64])
def test_as_the_standard_library_reads(spark, tmp_path, split_at, end, size):
    rng = random.Random(size)
    cell = lambda: "".join(rng.choice(["x", '"', ",", "\n", "\r\n", " ", "é"]) for _ in range(rng.randrange(1, 30)))
    rows = [[str(i), cell(), "z" + cell() + "z"] for i in range(60)]
    out, name = io.StringIO(), "two\nlines" if size > 20 else "b"  # a header lies in one split
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL).writerows([["id", name, "c"], *rows])
    (tmp_path / "t.csv").write_bytes(("﻿" + out.getvalue() + end).encode())
    split_at(size)
    df = C.read_tables(spark, [str(tmp_path / "t.csv")])
    assert df.columns[:3] == ["id", name, "c"] and df.rdd.getNumPartitions() > 4
    assert [list(r)[:3] for r in df.orderBy("_row_idx").collect()] == rows


def test_a_field_longer_than_many_splits(spark, tmp_path, split_at):
    long = "\n".join(f"line {i}" for i in range(200))
    (tmp_path / "t.csv").write_text(f'a,b\n1,"{long}"\n2,x\n3,"{long}"\n')
    split_at(50)
    rows = C.read_csv(spark, str(tmp_path / "t.csv")).orderBy("_row_idx").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("1", long), ("2", "x"), ("3", long)]


def test_names_encodings_and_many_headers(spark, tmp_path):
    assert D.column_names("a,,A,b\r") == ["a0", "_c1", "A2", "b"]
    for encoding in ("UTF-16", "ISO-8859-1"):
        (tmp_path / "g.csv").write_bytes('é,b\n"ü\nx",ß\n'.encode(encoding))
        assert C.read_csv(spark, str(tmp_path / "g.csv"), encoding=encoding).select("é", "b").collect() == [("ü\nx", "ß")]
    for i in range(20):
        (tmp_path / f"{i}.csv").write_text(f"a,{'b' if i % 2 else 'c'}\n{i},x\n")
    df = C.read_tables(spark, [str(tmp_path / f"{i}.csv") for i in range(20)])
    assert sorted((int(r["a"]), r["b"], r["c"]) for r in df.collect()) == [(i, *(("x", None) if i % 2 else (None, "x"))) for i in range(20)]


def test_sources_and_appended_results_keep_blanks(spark, tmp_path):
    rows = [("1", " a ", "s p/é"), ("2", "b\r", "1"), ("3", "\n", "1")]
    df = spark.createDataFrame(rows, f"k string, v string, {K.OUTPUT} string")
    K.write_by_source(df, str(tmp_path / "by"), "csv")
    assert sorted(map(tuple, K.read_by_source(spark, str(tmp_path / "by"), "csv").collect())) == rows
    for part in ("k = '1'", "k > '1'"):
        K.append_result(df.filter(part), str(tmp_path / "all"), ["k"], key="k", format="csv")
    assert sorted(map(tuple, K.read_result(spark, str(tmp_path / "all")).collect())) == rows


def test_splits_that_depend_on_the_files_of_a_scan(spark, tmp_path):
    """Spark makes smaller splits of fewer bytes; a file without line breaks beside one with them must not matter."""
    text = "\n".join(f"line {i}" for i in range(300))
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f"{i},plain\n" for i in range(4000)))
    (tmp_path / "b.csv").write_text("a,b\n" + "".join(f'{i},"{text}"\n' for i in range(4000, 4030)))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = C.read_csv(spark, str(tmp_path)).select("a", "b").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((int(r["a"]), r["b"]) for r in rows) == [(i, "plain" if i < 4000 else text) for i in range(4030)]


def test_another_number_of_splits_after_reading(spark, tmp_path, split_at):
    """Rows are asked for when the splits would be others, as with more or fewer cores."""
    text = "\n".join(f"line {i}" for i in range(50))
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f'{i},"{text}"\n' for i in range(100)))
    split_at(1000)
    df = C.read_csv(spark, str(tmp_path / "t.csv")).select("a", "b")
    split_at(3456)
    assert sorted((int(r["a"]), r["b"]) for r in df.collect()) == [(i, text) for i in range(100)]


def test_packs_of_a_few_bytes(spark, tmp_path, split_at, monkeypatch):
    rows = [(str(i), "\n".join(["x"] * (i % 7)) or None, 'q"\n' * (i % 3) or None) for i in range(60)]
    K.write_table(spark.createDataFrame(rows, "i string, v string, w string").coalesce(1), str(tmp_path / "o"), "csv")
    monkeypatch.setattr(D, "PACK", 3)
    split_at(40)
    found = C.read_csv(spark, str(tmp_path / "o")).orderBy("_row_idx").select("i", "v", "w").collect()
    assert list(map(tuple, found)) == rows


def test_sources_with_line_breaks_keep_their_names(spark, tmp_path):
    paths = []
    for folder in ("z", "a"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "t.csv").write_text(f'k,v\n{folder},"x\ny"\n')
        paths.append(str(tmp_path / folder / "t.csv"))
    named = K.with_output_name(C.read_tables(spark, paths), paths)
    assert sorted((r["k"], r["v"], r[K.OUTPUT], r[K.NUMBER]) for r in named.collect()) == [("a", "x\ny", "t_2", 1), ("z", "x\ny", "t", 0)]
