import zipfile

import pytest
from pyspark.sql import functions as F

from ruleloom.plans.samples import workbook_bytes
from ruleloom.sources import lines as L
from ruleloom.sources import pairs as BP
from ruleloom.sources import tables as C
from ruleloom.sources import workbook as W


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_is_read_as_text(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'code,note,"x y"\n020309,"a ""q"", b",1.50\n0807,,\n')
    df = C.read_csv(spark, path)
    assert df.dtypes[:3] == [("code", "string"), ("note", "string"), ("x y", "string")]
    assert [tuple(r)[:3] for r in df.orderBy("_row_idx").collect()] == [("020309", 'a "q", b', "1.50"), ("0807", None, None)]


def test_many_files_by_name(spark, tmp_path):
    first = put(tmp_path / "one" / "t.csv", "a,b\n1,2\n3,4\n")
    second = put(tmp_path / "two" / "t.csv", "b,c\n5,6\n")
    df = C.read_tables(spark, [first, str(tmp_path / "absent.csv"), second])
    found = sorted(((r["a"], r["b"], r["c"]) for r in df.collect()), key=str)
    assert found == [("1", "2", None), ("3", "4", None), (None, "5", "6")]
    with pytest.raises(FileNotFoundError):
        C.read_tables(spark, [str(tmp_path / "absent.csv")])


def test_other_columns_in_one_folder_are_an_error(spark, tmp_path):
    put(tmp_path / "d" / "1.csv", "a,b\n1,2\n")
    put(tmp_path / "d" / "2.csv", "b,a\n2,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        C.read_csv(spark, str(tmp_path / "d")).select("a").collect()


def test_row_numbers_follow_the_file(spark, tmp_path):
    path = put(tmp_path / "long.csv", "i\n" + "".join(f"{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = C.read_csv(spark, path, multi_line=False)
        assert df.rdd.getNumPartitions() > 4
        assert [int(r["i"]) for r in df.orderBy("_row_idx").collect()] == list(range(20000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_parquet_and_json_tables(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).selectExpr("id", "id * 0.5 as x").coalesce(1).write.parquet(path)
    df = C.read_tables(spark, [path])
    assert [(r["id"], r["_row_idx"]) for r in df.orderBy("_row_idx").collect()] == [(i, i) for i in range(5)]
    other = put(tmp_path / "t.csv", "x,id\n,007\n")
    mixed = C.read_tables(spark, [path, other])
    assert sorted((r["id"], r["x"]) for r in mixed.collect() if r["id"] > "0000") == [("007", None), *((str(i), str(i * 0.5)) for i in range(1, 5))]
    assert mixed.schema["_row_idx"].dataType.simpleString() == "bigint"
    path = put(tmp_path / "t.json", '{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert sorted((r["a"], r["b"]) for r in C.read_tables(spark, [path]).collect()) == [("1", "x"), ("2", None)]


BOOK = {
    "First": [["code", "名称", None, "n"], ["020309", "金融 <&>", "z", 3], ["0807", None, None, 3.5], ["x", "y", "w", True]],
    "Second": [["code", "extra"], ["a", "b"]],
    "Empty": [],
}


@pytest.fixture
def books(tmp_path):
    (tmp_path / "one.xlsx").write_bytes(workbook_bytes(BOOK))
    (tmp_path / "two.xlsx").write_bytes(workbook_bytes({"Second": [["code"], ["q"], ["r"]], "Third": [["code"], ["s"]]}))
    return [str(tmp_path / "one.xlsx"), str(tmp_path / "two.xlsx")]


def test_workbook_first_sheet(spark, books):
    rows = W.read_workbooks(spark, books, "").orderBy("_source_file", "_row_idx").collect()
    assert [tuple(r)[:4] for r in rows] == [
        ("020309", "金融 <&>", "z", "3"), ("0807", None, None, "3.5"), ("x", "y", "w", "True"),
        ("q", None, None, None), ("r", None, None, None),
    ]
    assert {r["_sheet"] for r in rows} == {"First", "Second"}


def test_workbook_sheets(spark, books):
    assert W.read_workbooks(spark, books, "*").count() == 7
    named = W.read_workbooks(spark, books, "Second, Nowhere")
    assert sorted(r["code"] for r in named.collect()) == ["a", "q", "r"] and "extra" in named.columns
    with pytest.raises(ValueError, match="none of the sheets"):
        W.read_workbooks(spark, books, "Nowhere")


def test_other_sheets_are_not_parsed(spark, tmp_path):
    """A sheet that is no XML is harmless unless it is chosen."""
    whole, path = tmp_path / "whole.xlsx", tmp_path / "broken.xlsx"
    whole.write_bytes(workbook_bytes({"A": [["v"], ["1"]], "B": [["v"], ["2"]], "C": [["v"], ["3"]]}))
    with zipfile.ZipFile(whole) as book, zipfile.ZipFile(path, "w") as copy:
        for name in book.namelist():
            copy.writestr(name, b"<no" if name.endswith("s2.xml") else book.read(name))
    for sheet, values in (("", ["1"]), ("C, A", ["1", "3"]), ("C", ["3"])):
        assert sorted(r["v"] for r in W.read_workbooks(spark, [str(path)], sheet).collect()) == values
    with pytest.raises(Exception):
        W.read_workbooks(spark, [str(path)], "*").collect()


def test_workbook_shared_strings(spark, tmp_path):
    """Shared strings with rich text and phonetic guides, rows with gaps and cell references."""

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    relations = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    path = tmp_path / "s.xlsx"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{relations}"><sheets><sheet name="S" r:id="a"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/w.xml"/></Relationships>')
        strings = "<si><t>head</t></si><si><r><t>中</t></r><r><t>文</t></r><rPh><t>zhong</t></rPh></si>"
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>{strings}</sst>")
        rows = '<row><c r="A1" t="s"><v>0</v></c><c r="AB1" t="str"><v>far</v></c></row><row><c r="AB2" t="s"><v>1</v></c></row><row/>'
        book.writestr("xl/w.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    found = [tuple(r)[:2] for r in W.read_workbooks(spark, [str(path)]).orderBy("_row_idx").collect()]
    assert found == [(None, "中文"), (None, None)]


def test_sheet_choice(spark):
    df = spark.createDataFrame([("f", "B", 0, 1), ("f", "A", 1, 2), ("g", "A", 0, 3)], "_source_file string, _sheet string, _sheet_no int, v int")
    pick = lambda s: sorted(r["v"] for r in C.select_sheets(df, s).collect())
    assert (pick(""), pick("*"), pick("A"), pick("A, B")) == ([1, 3], [1, 2, 3], [2, 3], [1, 2, 3])


def test_lines(spark, tmp_path):
    path = put(tmp_path / "r.txt", "﻿first\nsecond\n\nlast\n")
    assert [r["line"] for r in L.read_lines(spark, path).orderBy("_row_idx").collect()] == ["first", "second", "", "last"]


def test_lines_of_any_encoding(spark, tmp_path):
    text = "信息管理（120503）\r\n\n软件工程\n"
    paths = [put(tmp_path / f"{e}.txt", text, e) for e in ("utf-8", "gbk", "utf-8-sig")]
    paths.append(str(tmp_path / "broken.txt"))
    (tmp_path / "broken.txt").write_bytes(b"ok \xff\xff\xff\nnext")
    found = {}
    for r in L.read_mixed_lines(spark, paths).orderBy("_row_idx").collect():
        found.setdefault(r["_source_file"].rsplit("/", 1)[-1], []).append(r["line"])
    good = ["信息管理（120503）", "", "软件工程"]
    assert found == {"utf-8.txt": good, "gbk.txt": good, "utf-8-sig.txt": good, "broken.txt": ["ok ", "next"]}


def test_pair_files(spark, tmp_path):
    path = put(tmp_path / "p.json", '[{"zh": "你好", "en": "hello"}, {"zh": "", "en": "x"}, {"zh": "a"}, {"zh": 5, "en": "y", "z": 1}]')
    assert [tuple(r) for r in BP.read_pairs_json(spark, path).collect()] == [("你好", "hello")]
    path = put(tmp_path / "q.json", '[{"zh": ["a"], "en": "y"}, 7, "s", null, {"en": "b", "zh": "一"}]')
    assert [tuple(r) for r in BP.read_pairs_json(spark, path).collect()] == [("一", "b")]
    path = put(tmp_path / "p.md", "你好\n世界\n\nhello world\n\n再见\nbye\n多余\n")
    pairs = BP.read_pairs_markdown(spark, path).orderBy("pair_idx").collect()
    assert [(r["zh"], r["en"]) for r in pairs] == [("你好世界", "hello world"), ("再见", "bye")]


def test_pair_export_and_import(spark, tmp_path):
    pairs = [("d2", "你好", "hello"), ("d2", "一", "one"), ("d3", " 二 ", " two "), ("d3", "", "none"), ("d3", "三", None)]
    df = spark.createDataFrame(pairs, "dataset string, zh string, en string")
    md = str(tmp_path / "md")
    BP.write_pairs_markdown(df, md)
    back = BP.read_pairs_markdown(spark, md)
    assert sorted((r["zh"], r["en"]) for r in back.collect()) == [("一", "one"), ("二", "two"), ("你好", "hello")]
    plain = str(tmp_path / "json")
    BP.write_pairs_json(df, plain)
    assert BP.read_pairs_json(spark, plain, array_file=False).count() == 3
    root = str(tmp_path / "sets")
    BP.write_datasets(df, root)
    assert BP.dataset_names(spark, root) == ["d2", "d3"]
    names = [BP.import_pairs(df.filter("dataset = 'd2'"), root, "x") for _ in range(3)]
    assert names == ["user_x", "user_x_1", "user_x_2"]
    assert BP.dataset_names(spark, root) == ["d2", "d3", *names]
    assert BP.read_datasets(spark, root).filter(F.col("dataset") == "user_x_2").count() == 2


def test_fields_with_line_breaks(spark, tmp_path):
    path = put(tmp_path / "q.csv", 'a,b\n1,"two\nlines, ""quoted"""\n2,x\n')
    assert [(r["a"], r["b"]) for r in C.read_tables(spark, [path]).collect()] == [("1", 'two\nlines, "quoted"'), ("2", "x")]
    (tmp_path / "l.csv").write_bytes("a\né\n".encode("latin-1"))
    assert C.read_tables(spark, [str(tmp_path / "l.csv")], encoding="ISO-8859-1").first()["a"] == "é"


def test_formats_by_ending(spark, tmp_path):
    folder = str(tmp_path / "result")
    spark.range(3).write.parquet(folder)
    assert C.read_tables(spark, [folder]).count() == 3
    odd = put(tmp_path / "t.xls", "a\n1\n")
    with pytest.raises(ValueError, match="format"):
        C.read_tables(spark, [odd])
    assert C.read_tables(spark, [odd], format="csv").count() == 1


def test_one_scan_for_many_files(spark, tmp_path):
    paths = [put(tmp_path / f"f{i}.csv", f"a,b\n{i},x\n") for i in range(12)] + [put(tmp_path / "g.csv", "b,c\ny,z\n")]
    df = C.read_tables(spark, paths)
    assert df.count() == 13 and df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_workbook_headers(spark, tmp_path):
    book = {"First": [["h", "h", "x"]], "Second": [["h", "h"], ["1", "2"]]}
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes(book))
    path = [str(tmp_path / "b.xlsx")]
    assert W.read_workbooks(spark, path, "").count() == 0  # the first sheet is the first, also without rows
    assert [(r["h0"], r["h1"]) for r in W.read_workbooks(spark, path, "*").collect()] == [("1", "2")]
