from ruleloom.functions import text as X


def test_halfwidth(evaluate):
    assert evaluate(X.to_halfwidth, ["１２０５０３", "ＡＢｃ（１）", "a　b", "中文", None]) == ["120503", "ABc(1)", "a b", "中文", None]


def test_normalize_spaces(evaluate):
    given = ["  Ａ　 b\n\tC ", "x  y", "", "信息  管理（1）"]
    assert evaluate(X.normalize_spaces, given) == ["a b c", "x y", "", "信息 管理(1)"]


def test_normalize_strict(evaluate):
    given = ["信息 资源-管理（120503）", "Ａｂ C!é_9", " ！！ ", "龥鿿㐀"]
    assert evaluate(X.normalize_strict, given) == ["信息资源管理120503", "abc9", "", "龥鿿"]


def test_normalize_strict_agrees_with_plain_definition(evaluate):
    import random
    import re

    rng = random.Random(3)
    alphabet = "aZ09 .,-_/\\'\"!?~（）！～ＡｚＺ９　中文鿿éßÅ\t\n\x0b"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(300)]

    def plain(t):
        half = "".join(" " if c == "　" else chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in t)
        return re.sub("[^0-9a-z一-鿿]", "", half.lower())

    assert evaluate(X.normalize_strict, texts) == [plain(t) for t in texts]


def test_spaces_agree_with_plain_definition(evaluate):
    import random
    import re

    rng = random.Random(4)
    texts = ["".join(rng.choice("aB \t\n\x0b\x1c\x85\xa0 　中") for _ in range(rng.randint(0, 15))) for _ in range(300)]
    plain = [re.sub(r"\s+", " ", t.replace("　", " ").strip().lower()) for t in texts]
    assert evaluate(X.normalize_spaces, texts) == plain


def test_extract_code(evaluate):
    given = ["软件工程080902TK", "12345678", "123", "a1234b567890", "", None, "0807"]
    assert evaluate(X.extract_code, given) == ["080902", "123456", "", "1234", "", "", "0807"]


def test_digits_only(evaluate):
    assert evaluate(X.digits_only, ["专业 0809-02TK", "abc"]) == ["080902", ""]


def test_has_chinese(evaluate):
    assert evaluate(X.has_chinese, ["abc中", "abc", "（）", "", None]) == [True, False, False, False, False]
