import random

import pytest

import plain
from ruleloom.operators import match as M

LINES = ["信息资源管理（120503）", " 软件工程（ 080902TK ）", "", "1 工学 软件工程", "软件工程 080902", "信息资源管理（120503）",
         "   ", "软件 工程 0809", "计算机", "120503", "（120503）", "智能体育工程（040211）后缀", "！！！"]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "_row_idx long, line string")


def test_parse_requirements(lines):
    found = [(r["req_idx"], r["name"], r["norm"], r["code"]) for r in M.parse_requirements(lines).orderBy("req_idx").collect()]
    assert found == [
        (0, "信息资源管理", "信息资源管理", "120503"),
        (1, "软件工程", "软件工程", "080902"),
        (3, "软件工程", "软件工程", ""),
        (7, "工程", "工程", "0809"),
        (8, "计算机", "计算机", ""),
        (9, "120503", "120503", "120503"),
        (11, "智能体育工程", "智能体育工程", "040211"),
        (12, "！！！", "", ""),
    ]


def matched(df):
    rows = df.collect()
    return {r["id"]: (r["_match"], r["_matched_name"], r["_matched_code"], r["_score"]) for r in rows}


TEXTS = ["信息资源管理（120503）", "信息资源管理", "信息资源", "资源信息管理", "软件工程080902TK", "XX软件工程专业", "计算机科学", "", None,
         "。。。", "数学", "智能体育", "体育智能工程", "Software", "工程软件", "12050"]


@pytest.mark.parametrize("shipped", [M.SHIPPED_LIST, 3])
@pytest.mark.parametrize("threshold", [0.0, 0.8, 0.92])
def test_against_plain(spark, lines, monkeypatch, shipped, threshold):
    monkeypatch.setattr(M, "SHIPPED_LIST", shipped)
    reqs = M.parse_requirements(lines)
    listed = [(r["name"], r["code"]) for r in reqs.orderBy("req_idx").collect()]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, major string")
    found = matched(M.best_match(df, "major", reqs, threshold))
    for i, text in enumerate(TEXTS):
        hit, name, code, score = plain.best(text, listed, threshold)
        assert found[i] == (hit, name, code, pytest.approx(score, abs=5.1e-5)), text


def test_near_name_beats_equal_name(spark):
    """The ladder is not monotone: a ratio above 0.95 wins over an equal text."""
    long = "a" * 30 + "bcdefghij" * 3
    reqs = [(long, "", 0), (long + "k", "", 1)]
    df = spark.createDataFrame([(0, long)], "id int, major string")
    frame = spark.createDataFrame([(n, n, c, i) for n, c, i in reqs], "name string, norm string, code string, req_idx long")
    assert matched(M.best_match(df, "major", frame))[0][3] == 0.95  # one inside the other stays at 0.9
    frame = spark.createDataFrame(
        [(long, long, "", 0), (long[:-1] + "x", long[:-1] + "x", "", 1)], "name string, norm string, code string, req_idx long"
    )
    hit = matched(M.best_match(df, "major", frame))[0]
    assert hit[1] == long[:-1] + "x" and hit[3] == pytest.approx(2 * 56 / 114, abs=1e-4)


def test_list_in_blocks_against_plain(spark, monkeypatch):
    """A list cut into blocks gives what the whole list gives; one value holds a third of all rows."""
    rng = random.Random(11)
    names = list(dict.fromkeys("".join(rng.choice("信息工程管理科学ab") for _ in range(rng.randint(1, 6))) for _ in range(80)))
    reqs = [(n, n, f"{i:04d}" if i % 3 == 0 else "", i) for i, n in enumerate(names)]
    texts = ["".join(rng.choice("信息工程管理科学ab") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts += [f"x{i:04d}" for i in range(0, 30, 3)] + ["信息工程"] * 40 + [None, None, ""]
    frame = spark.createDataFrame(reqs, "name string, norm string, code string, req_idx long")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, major string")
    whole = matched(M.best_match(df, "major", frame, 0.5))
    monkeypatch.setattr(M, "SHIPPED_LIST", 10)
    monkeypatch.setattr(M, "BLOCK", 16)
    found = matched(M.best_match(df, "major", frame, 0.5))
    assert len(found) == len(texts)
    listed = [(n, c) for n, _, c, _ in reqs]
    for i, text in enumerate(texts):
        hit, name, code, score = plain.best(text, listed, 0.5)
        assert found[i] == (hit, name, code, pytest.approx(score, abs=5.1e-5)), text
    assert found == whole
    exact = matched(M.best_match(df, "major", frame, 0.5, similarity="none"))
    monkeypatch.setattr(M, "RESULT_BYTES", 0)
    assert matched(M.best_match(df, "major", frame, 0.5, similarity="none")) == exact
    monkeypatch.setattr(M, "SHIPPED_LIST", 1000)
    for most in (500, 10):
        monkeypatch.setattr(M, "PLAIN_LIST", most)
        assert matched(M.best_match(df, "major", frame, 0.5, similarity="none")) == exact


@pytest.mark.parametrize("similarity", ["sequence", "none"])
@pytest.mark.parametrize("plain_list", [500, 1])
def test_requirements_in_two_files(spark, monkeypatch, tmp_path, similarity, plain_list):
    """Line numbers repeat from file to file; each line stays a requirement of its own."""
    from ruleloom.sources.lines import read_mixed_lines

    monkeypatch.setattr(M, "PLAIN_LIST", plain_list)
    for name, text in (("1.txt", "oak\npine（1111）\n"), ("2.txt", "ash\nelm（2222）\noak\n")):
        (tmp_path / name).write_text(text)
    reqs = M.parse_requirements(read_mixed_lines(spark, [str(tmp_path)]))
    assert [(r["req_idx"], r["name"]) for r in reqs.orderBy("req_idx").collect()] == [(0, "oak"), (1, "pine"), (2, "ash"), (3, "elm")]
    df = spark.createDataFrame([(0, "ash"), (1, "x 2222"), (2, "oak"), (3, None), (4, "ash")], "id int, major string")
    found = M.best_match(df, "major", reqs, 0.9, similarity=similarity)
    assert found.count() == 5
    assert {i: r[1] for i, r in matched(found).items()} == {0: "ash", 1: "elm", 2: "oak", 3: "", 4: "ash"}


def test_errors(spark, lines):
    df = spark.createDataFrame([("x",)], "major string")
    with pytest.raises(ValueError, match="does not exist"):
        M.best_match(df, "Major2", M.parse_requirements(lines))
    with pytest.raises(ValueError, match="empty"):
        M.best_match(df, "major", M.parse_requirements(lines.filter("false")))


def test_short_list_needs_no_shuffle(spark, lines):
    df = spark.range(10).selectExpr("cast(id as string) as major")
    plan = M.best_match(df, "major", M.parse_requirements(lines))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
