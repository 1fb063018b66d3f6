"""Literal cases for the scalar functions (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from threadscope.functions import keywords as K
from threadscope.functions import numeric as N
from threadscope.functions import text as X


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("Crash on PS5 and my PC", ["pc", "playstation"]),
    ("upcoming", ["pc"]),
    ("hello", ["unspecified"]), ("", ["unspecified"]), (None, ["unspecified"]),
])
def test_x1_platform(spark, text, expected):
    assert one(spark, K.detect_platform("x"), text) == expected


@pytest.mark.parametrize("text,expected", [
    ("Game breaking freeze", "critical"), ("freeze only", "high"), ("quick question", "medium"),
    ("context", "low"), ("hello", "unspecified"), ("", "unspecified"), (None, "unspecified"),
])
def test_x2_severity(spark, text, expected):
    assert one(spark, K.detect_severity("x"), text) == expected


@pytest.mark.parametrize("text,expected", [
    ("Flag carrier request", "Bug"), ("Feature request", "Feature Request"),
    ("what is this", "Question"), ("Shower thoughts", "Question"), ("hello", "Other"),
    (" ", "Other"), ("", "Uncategorized"), (None, "Uncategorized"),
])
def test_x3_label(spark, text, expected):
    assert one(spark, K.label_post("x"), text) == expected


def test_x4_keywords_found_keeps_duplicates(spark):
    assert one(spark, K.keywords_found("x"), "fix the lag") == ["fix", "lag", "fix"]
    assert one(spark, K.keywords_found("x"), "buggy patch") == ["bug", "buggy", "patch"]
    assert one(spark, K.keywords_found("x"), None) == []


def test_word_boundary_option(spark):
    assert one(spark, K.detect_severity("x", word_boundary=True), "quick question") == "unspecified"
    assert one(spark, K.has_any("x", ["fix"], word_boundary=True), "prefix") is False
    assert one(spark, K.has_any("x", ["fix"]), "prefix") is True


def test_x8_normalize_title(spark):
    assert one(spark, X.normalize_title(F.col("x")), "Tom Clancy's Rainbow Six® Siege") == \
        "tom clancys rainbow six siege"
    assert one(spark, X.normalize_title(F.col("x")), "A - B") == "a  b"


def test_x9_strip(spark):
    assert one(spark, X.strip("x"), "\t  a b \n") == "a b"


def test_x10_mask(spark):
    assert one(spark, X.mask_handles_urls(F.col("x")), "@bob see https://x.y and @") == "@user see http and @"


def test_x11_x13_x26(spark):
    assert one(spark, X.clean_markup(F.col("x")), "#tag_name") == "tag name"
    df = spark.createDataFrame([(None, "b")], "t string, x string")
    assert df.select(X.full_text("t", "x")).first()[0] == " b"
    assert one(spark, X.underline(F.col("x")), "Hi") == "=="


def test_x12_epoch(spark):
    assert one(spark, X.epoch_to_iso(F.col("x")), 0, "x long") == "1970-01-01T00:00:00"


def test_x15_make_int(spark):
    df = spark.createDataFrame([(0.3,), (-0.01,), (0.0,)], "x double")
    assert [r[0] for r in df.select(N.make_int("x")).collect()] == [1, -1, 0]


def test_x18_argmax_to_polarity(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0],), ([0.1, 2.0, 0.3],)], "x array<double>")
    out = df.select(N.label_to_polarity(N.argmax(N.softmax("x")))).collect()
    assert [r[0] for r in out] == [-1, 0]
    s = df.select(N.softmax("x")).collect()[1][0]
    assert abs(sum(s) - 1.0) < 1e-12


@pytest.mark.parametrize("n,expected", [
    (14, [(1, 6), (4, 9), (7, 12), (10, 14)]), (0, [None]), (6, [(1, 6)]), (7, [(1, 6), (4, 7)]),
])
def test_x19_windows(spark, n, expected):
    toks = [str(i) for i in range(1, n + 1)]
    w = one(spark, N.token_windows("x", 6, 3), toks, "x array<string>")
    got = [(int(c[0]), int(c[-1])) if c else None for c in w]
    assert got == expected


@pytest.mark.parametrize("votes,expected", [
    ([1, 0], 0), ([1, 1, 0], 1), ([-1, 0], 0), ([-1, -1, 0], -1), ([1, -1], 0)])
def test_a12_vote(spark, votes, expected):
    df = spark.createDataFrame([(v,) for v in votes], "p int")
    assert df.agg(N.vote("p")).first()[0] == expected


def test_x20_x27(spark):
    df = spark.createDataFrame([("positive",), ("negative",), ("neutral",)], "x string")
    assert [r[0] for r in df.select(N.sentiment_boost("x")).collect()] == [1.1, 1.3, 1.0]
    assert one(spark, N.cluster_count("x"), 9, "x int") == 5


def test_x21_sentence_pieces(spark):
    assert one(spark, X.sentence_pieces("x"), "Hi there. Yes!  ok ") == ["Hi there.", "Yes!", "ok "]
    assert one(spark, X.sentence_pieces("x"), "end. ") == ["end.", ""]


def test_x22_tokenize(spark):
    assert one(spark, X.tokenize("x"), "Hello, #big_world 42x") == ["hello", "big", "world", "42x"]


def test_x23_bullets(spark):
    assert one(spark, X.bullets("x"), ["a", "b"], "x array<string>") == "- a\n- b"


def test_x19_windows_cover_every_token(spark):
    """Property: windows start every (size - overlap) tokens, the last one
    reaches the end, and together they cover every token."""
    import random
    rnd = random.Random(5)
    cases = [(rnd.randint(0, 60), rnd.randint(2, 9)) for _ in range(200)]
    rows = [(i, [str(t) for t in range(n)], size, rnd.randint(0, size - 1)) for i, (n, size) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, t array<string>, size int, overlap int")
    got = {}
    for size in range(2, 10):
        for ov in range(0, size):
            sub = df.where((F.col("size") == size) & (F.col("overlap") == ov))
            for r in sub.select("id", N.token_windows("t", size, ov).alias("w")).collect():
                got[r.id] = r.w
    for i, toks, size, ov in rows:
        w = got[i]
        assert len(w) >= 1
        covered = [x for chunk in w for x in chunk]
        assert set(covered) == set(toks)
        if toks:
            assert w[-1][-1] == toks[-1]
            assert all(len(c) == size for c in w[:-1])
            assert all(w[k][0] == toks[k * (size - ov)] for k in range(len(w)))
