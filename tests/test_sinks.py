import os

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import rules as R
from ruleloom.operators import screen as S
from ruleloom.plans import jobs
from ruleloom.plans.samples import workbook_bytes
from ruleloom.sources import sinks as K
from ruleloom.sources import tables as C
from ruleloom.streaming.screening import append_stream, dedup_stream, screen_stream


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_one_folder_per_source(spark, tmp_path):
    paths = [put(tmp_path / d / "t.csv", f"a\n{d}1\n{d}2\n") for d in ("x", "y")]
    paths.append(put(tmp_path / "z" / "名 单.csv", "a\nz1\n"))
    df = C.read_tables(spark, paths)
    out = str(tmp_path / "out")
    K.write_by_source(K.with_output_name(df, paths), out, format="csv")
    back = C.read_csv(spark, out)
    found = sorted((r["a"], r["_source"]) for r in back.select("a", "_source").collect())
    assert found == [("x1", "t"), ("x2", "t"), ("y1", "t_2"), ("y2", "t_2"), ("z1", "名 单")]


def test_unknown_format_becomes_csv(spark, tmp_path):
    K.write_table(spark.range(3), str(tmp_path / "o"), format="xlsx")
    assert any(f.endswith(".csv") for f in os.listdir(tmp_path / "o"))


def test_append_versions(spark, tmp_path):
    path = str(tmp_path / "r")
    first = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, i int")
    second = spark.createDataFrame([("b", 0), ("c", 1)], "k string, i int")
    K.append_result(first, path, ["i"], key="k")
    K.append_result(second, path, ["i"], key="k")
    assert sorted(map(tuple, K.read_result(spark, path).collect())) == [("a", 1), ("b", 2), ("c", 1)]
    assert K.latest_version(spark, path).endswith("v000001")  # the second run is a layer that holds its new key alone
    assert [tuple(r) for r in spark.read.parquet(f"{path}/v000001-000001").collect()] == [("c", 1)]
    (tmp_path / "r" / "v000003").mkdir()  # runs that broke off
    (tmp_path / "r" / "v000001-000002").mkdir()
    assert K.append_result(second, path, ["i"], deduplicate=False).endswith("v000001-000003")
    assert K.read_result(spark, path).count() == 5
    # Rows that were not deduplicated, or by another key, are so by a whole new version.
    assert K.append_result(second, path, ["i"], key="k").endswith("v000004")
    assert sorted(map(tuple, K.read_result(spark, path).collect())) == [("a", 1), ("b", 0), ("c", 1)]
    assert K.append_result(first, path, ["k"], key="i").endswith("v000005")
    assert sorted(r["i"] for r in K.read_result(spark, path).collect()) == [0, 1, 2, 3]
    assert K.drop_older(spark, path) == ["v000001", "v000001-000001", "v000001-000003", "v000004"]
    assert K.read_result(spark, path).count() == 4


def test_layers_of_other_columns_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MOST_LAYERS", 3)
    for format in ("parquet", "csv"):
        path = str(tmp_path / format)
        runs = [
            ("k string, i int", [("a", 1), (None, 2)]),
            ("k string, i int, more string", [("a", 0, "x"), (None, 0, "y"), ("b", 3, " z ")]),
            ("more string, k string, i int", []),
            ("k string, i int", [("b", 0), ("c", 4)]),
        ]
        made = [K.append_result(spark.createDataFrame(rows, schema), path, ["i"], key="k", format=format) for schema, rows in runs]
        assert [m.rpartition("/")[2] for m in made] == ["v000001", "v000001-000001", "v000001-000002", "v000002"]
        found = K.read_result(spark, path).select("k", F.col("i").cast("int"), "more").collect()
        assert sorted(map(tuple, found), key=str) == sorted([("a", 1, None), (None, 2, None), ("b", 3, " z "), ("c", 4, None)], key=str)
        assert K.compact(spark, path, format).endswith("v000003")
        assert K.append_result(spark.createDataFrame([("c", 0), ("d", 5)], "k string, i int"), path, ["i"], key="k", format=format).endswith("v000003-000001")
        assert K.read_result(spark, path).count() == 5


def test_rule_export(spark, tmp_path):
    rows = [("a", "regex", "match", r'^\d+"x",\s$'), ("b", "text", "equals", "007741", "", "3", "0.5", "k=1;k=2")]
    K.export_rules(R.rule_frame(spark, rows), str(tmp_path / "rules"))
    back = R.load_rules(spark, str(tmp_path / "rules"))
    assert sorted(map(tuple, back.collect())) == sorted(tuple(r) + ("",) * (8 - len(r)) for r in rows)


RULES = [("Weight", "number", "min", "7.5", "", "", "0.25"), ("Part", "code", "equals", "440871")]


def candidates(tmp_path):
    first = put(tmp_path / "in" / "one.csv", "PersonID,Part,Weight\n1,oak（440871）,3\n2,tile,8.9\n3,tile,2\n1,x,9\n")
    second = put(tmp_path / "in" / "two.csv", "PersonID,Part\n2,oak 440871\n4,440871\n5,\n")
    return [first, second]


def test_screening_job(spark, tmp_path):
    out = str(tmp_path / "out")
    counts = jobs.screen_files(spark, candidates(tmp_path), RULES, out, key="PersonID")
    assert sorted((r["_source"] or "all", r["rows"], r["hits"]) for r in counts.collect()) == [
        ("all", 7, 5), ("one", 4, 3), ("two", 3, 2),
    ]
    by_source = spark.read.parquet(f"{out}/by_source")
    assert sorted((r["_source"], r["PersonID"]) for r in by_source.collect()) == [
        ("one", "1"), ("one", "2"), ("two", "2"), ("two", "4"),
    ]
    merged = K.read_result(spark, f"{out}/merged")
    assert sorted((r["PersonID"], r["_score_all"]) for r in merged.collect()) == [("1", 1.0), ("2", 0.25), ("4", 1.0)]


def test_screening_job_merge_only_and_append(spark, tmp_path):
    out, paths = str(tmp_path / "out"), candidates(tmp_path)
    jobs.screen_files(spark, paths[:1], RULES, out, key="PersonID", merge_only=True)
    jobs.screen_files(spark, paths[1:], RULES, out, key="PersonID", merge_only=True, append=True)
    assert not (tmp_path / "out" / "by_source").exists()
    merged = K.read_result(spark, f"{out}/merged")
    assert sorted((r["PersonID"], r["_score_all"]) for r in merged.collect()) == [("1", 1.0), ("2", 0.25), ("4", 1.0)]
    jobs.screen_files(spark, paths[1:], RULES, out, key="PersonID", merge_only=True)
    assert K.read_result(spark, f"{out}/merged").count() == 2


def test_runs_append_per_source(spark, tmp_path):
    out, paths = str(tmp_path / "out"), candidates(tmp_path)
    for format in ("parquet", "csv"):
        for _ in range(2):
            counts = jobs.screen_files(spark, paths, RULES, f"{out}/{format}", key="PersonID", append=True, format=format)
        assert {r["_source"]: r["hits"] for r in counts.collect()} == {"one": 3, "two": 2, None: 5}
        by_source = K.read_by_source(spark, f"{out}/{format}/by_source", format)
        assert sorted((r["_source"], str(r["PersonID"])) for r in by_source.collect()) == [("one", "1"), ("one", "2"), ("two", "2"), ("two", "4")]
        assert K.read_result(spark, f"{out}/{format}/merged").count() == 3
        assert K.format_of(spark, K.latest_version(spark, f"{out}/{format}/merged")) == format


def test_first_source_given_wins(spark, tmp_path):
    paths = [put(tmp_path / f"{n}.csv", f"PersonID,v\n1,{n}\n") for n in "za"]
    jobs.screen_files(spark, paths, [("PersonID", "number", "min", "0")], str(tmp_path / "out"), key="PersonID")
    assert [r["v"] for r in K.read_result(spark, str(tmp_path / "out" / "merged")).collect()] == ["z"]


def test_patterns_and_relative_folders(spark, tmp_path, monkeypatch):
    candidates(tmp_path)
    monkeypatch.chdir(tmp_path)
    for given in (str(tmp_path / "in" / "*.csv"), "in/*.csv"):
        try:
            counts = jobs.screen_files(spark, [f"file:{given}" if given[0] == "/" else given], RULES, str(tmp_path / f"out{len(given)}"), key="PersonID")
        except FileNotFoundError:  # a session started elsewhere resolves relative paths against its own folder
            assert given[0] != "/"
            continue
        assert {r["_source"]: (r["rows"], r["hits"]) for r in counts.collect()} == {"one": (4, 3), "two": (3, 2), None: (7, 5)}


def test_nothing_to_deduplicate_by(spark, tmp_path):
    path = put(tmp_path / "x.csv", "a\n1\n")
    with pytest.raises(ValueError, match="deduplicate"):
        jobs.screen_files(spark, [path], RULES, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_no_hits_write_empty_outputs(spark, tmp_path):
    out = str(tmp_path / "out")
    counts = jobs.screen_files(spark, candidates(tmp_path), [("Part", "text", "equals", "none")], out, key="PersonID", audit=True)
    assert {r["hits"] for r in counts.collect()} == {0}
    merged = K.read_result(spark, f"{out}/merged")
    assert merged.count() == 0 and "_cond_1_match" in merged.columns


def test_job_limit(spark, tmp_path):
    out = str(tmp_path / "out")
    counts = jobs.screen_files(spark, candidates(tmp_path), RULES, out, key="PersonID", limit=2)
    assert {r["_source"] or "all": r["rows"] for r in counts.collect()} == {"all": 4, "one": 2, "two": 2}


def test_job_over_parquet_and_absent_path(spark, tmp_path):
    paths = [str(tmp_path / f"{n}.parquet") for n in ("a", "b", "absent")]
    for p, n in zip(paths, (10, 20)):
        spark.range(n).selectExpr("id as PersonID", "id as x").write.parquet(p)
    counts = jobs.screen_files(spark, paths, [("x", "number", "min", "8")], str(tmp_path / "out"), key="PersonID")
    assert sorted((r["_source"] or "all", r["rows"], r["hits"]) for r in counts.collect()) == [("a", 10, 2), ("all", 30, 14), ("b", 20, 12)]
    assert K.read_result(spark, str(tmp_path / "out" / "merged")).count() == 12


def test_job_over_workbooks(spark, tmp_path):
    rows = lambda n: [["PersonID", "Weight"], *([str(i), i] for i in range(n))]
    for name in ("a", "b"):
        (tmp_path / f"{name}.xlsx").write_bytes(workbook_bytes({"S1": rows(6), "S2": rows(3)}))
    paths = [str(tmp_path / f"{name}.xlsx") for name in ("a", "b")]
    rules = [("Weight", "number", "min", "1")]
    counts = {}
    for sheet, limit in (("", None), ("*", 2), ("S2,none", None)):
        out = str(tmp_path / f"out{len(counts)}")
        found = jobs.screen_files(spark, paths, rules, out, sheet=sheet, limit=limit, deduplicate=False)
        counts[sheet] = {r["_source"] or "all": (r["rows"], r["hits"]) for r in found.collect()}
    assert counts[""] == {"a": (6, 5), "b": (6, 5), "all": (12, 10)}
    assert counts["*"] == {"a": (4, 2), "b": (4, 2), "all": (8, 4)}  # the limit holds per sheet
    assert counts["S2,none"] == {"a": (3, 2), "b": (3, 2), "all": (6, 4)}


def test_matching_job(spark, tmp_path):
    reqs = put(tmp_path / "require.txt", "oak（440871）\ntile 5512\n")
    out = str(tmp_path / "out")
    jobs.match_files(spark, candidates(tmp_path), reqs, out, column="Part", key=None)
    merged = K.read_result(spark, f"{out}/merged")
    # without a key column, the normalised text with the matched code is the key
    assert sorted((r["PersonID"], r["_matched_name"], r["_score"]) for r in merged.collect()) == [
        ("1", "oak", 1.0), ("2", "tile", 0.95), ("4", "oak", 1.0),
    ]


SCHEMA = "k string, i int, v double"


def test_stream_screen(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: screen_stream(
        spark.readStream.schema(SCHEMA).parquet(src), [("v", "number", "min", "2")], out, str(tmp_path / "cp")
    ).awaitTermination()
    spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], SCHEMA).write.parquet(src)
    run()
    spark.createDataFrame([("c", 3, 3.0)], SCHEMA).write.mode("append").parquet(src)
    run()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["b", "c"]


def test_stream_append(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("a", 2, 0.0), ("a", 1, 1.0), ("b", 1, 2.0)], [("a", 0, 3.0), ("c", 5, 4.0)], [(None, 1, 5.0), ("c", 1, 6.0)], [(None, 0, 7.0)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        append_stream(stream, out, str(tmp_path / "cp"), ["i"], key="k").awaitTermination()
    found = sorted((r["k"] or "", r["v"]) for r in spark.read.parquet(out).collect())
    assert found == [("", 5.0), ("a", 1.0), ("b", 2.0), ("c", 4.0)]


def test_stream_dedup(spark, tmp_path, monkeypatch):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    big = 2**53 + 1
    batches = [[("a", 2, 0.0), ("a", None, 1.0), ("b", 1, None)], [("a", 0, 3.0), ("c", 5, 4.0)], [(None, 1, 5.0), ("c", 1, 6.0)], [(None, 0, 7.0)]]
    schema = SCHEMA + ", n long"

    def run(suffix: str = ""):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        dedup_stream(stream, out + suffix, str(tmp_path / ("cp" + suffix)), ["i"], key="k").awaitTermination()

    for rows in batches:
        spark.createDataFrame([(*r, big) for r in rows], schema).coalesce(1).write.mode("append").parquet(src)
        run()
    found = sorted(((r["k"] or "", r["v"], r["n"]) for r in spark.read.parquet(out).collect()), key=lambda r: r[0])
    assert found == [("", 5.0, big), ("a", 1.0, big), ("b", None, big), ("c", 4.0, big)]  # nulls come first in the order


def test_stream_dedup_goes_on_after_a_failed_batch(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    @F.udf("string")
    def same(v):
        if v == "bad" and (tmp_path / "fail").exists():
            raise ValueError(v)
        return v

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        dedup_stream(stream.withColumn("k", same("k")), out, checkpoint, ["i"], key="k").awaitTermination()

    spark.createDataFrame([("a", 1, 1.0)], SCHEMA).coalesce(1).write.parquet(src)
    run()
    (tmp_path / "fail").touch()
    spark.createDataFrame([("a", 0, 2.0), ("bad", 1, 3.0), ("bad", 2, 4.0)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception):
        run()
    (tmp_path / "fail").unlink()
    run()
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == [1.0, 3.0]


def test_batch_can_be_run_again(spark, tmp_path):
    out = str(tmp_path / "out")
    first = spark.createDataFrame([("a", 1, 1.0)], SCHEMA)
    second = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 3.0)], SCHEMA)
    K.append_batch(first, 0, out, ["i"], "k", None)
    for _ in range(2):
        K.append_batch(second, 1, out, ["i"], "k", None)
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == [1.0, 3.0]


def test_empty_batches(spark, tmp_path):
    out, none = str(tmp_path / "out"), spark.createDataFrame([], SCHEMA)
    K.append_increment(none, out, ["i"], key="k")
    with pytest.raises(FileNotFoundError):
        K.read_batches(spark, out)
    K.append_increment(spark.createDataFrame([("a", 1, 1.0)], SCHEMA), out, ["i"], key="k")
    K.append_increment(none, out, ["i"], key="k")
    assert [(r["k"], r["_batch"]) for r in K.read_batches(spark, out).collect()] == [("a", 1)]


def test_append_increment(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    parts = [[("a", 2, 1.0), ("a", 1, 2.0)], [("a", 0, 3.0), (None, 1, 4.0)], [(None, 0, 5.0), ("b", 1, 6.0)]]
    for limit, rows in zip((500_000, 0, 0), parts):
        monkeypatch.setattr(K, "BROADCAST_BYTES", limit)
        K.append_increment(spark.createDataFrame(rows, SCHEMA), out, ["i"], key="k")
        broken = tmp_path / "out" / "_batch=9"  # a batch that broke off is neither read nor counted
        broken.mkdir(exist_ok=True)
    assert sorted((r["_batch"], r["v"]) for r in K.read_batches(spark, out).collect()) == [(0, 2.0), (1, 4.0), (2, 6.0)]


def test_screening_is_the_same_on_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(200).select(F.col("id").cast("string").alias("k"), F.col("id").cast("int").alias("i"), (F.col("id") / 7).alias("v"))
    df.write.parquet(src)
    rules = [("k", "fuzzy", "similar", "15", "0.6"), ("v", "number", "between", "3-5")]
    screen_stream(spark.readStream.schema(SCHEMA).parquet(src), rules, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "o")).collect()) == sorted(S.screen(df, rules, hits_only=True).collect())
