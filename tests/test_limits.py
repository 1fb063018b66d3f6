"""Inputs beyond the sizes that the driver's tables have."""

import json

import numpy as np
from pyspark.sql import functions as F

from threadscope.functions import keywords as K
from threadscope.functions import text as X
from threadscope.operators import enrich as EN
from threadscope.operators import fingerprints as FP
from threadscope.operators import matching as M
from threadscope.operators import models as MO
from threadscope.operators import sampling as SA
from threadscope.sources import posts_io as IO


def test_gazetteer_names_of_any_length_with_marks_and_digits(spark):
    names = ["The Legend of Zelda Breath of the Wild", "Half-Life 2", "Portal 2", "Elden Ring", "!!!"]
    gz = spark.createDataFrame([(n,) for n in names], "name string")
    df = spark.createDataFrame([(1, "I like the legend of zelda: breath of the wild, half life 2 and Portal 2."), (2, "elden ring"), (3, None)],
                               "id long, text string")
    got = {r.id: r.mentions for r in M.entity_mentions(df, "id", "text", gz).collect()}
    assert got == {1: sorted(["the legend of zelda breath of the wild", "half-life 2", "portal 2"]), 2: ["elden ring"]}


def test_large_lexicon_scores_like_a_small_one(spark):
    lex = [(f"w{i}", (i % 3 - 1) / 2, 0.5) for i in range(300)] + [("w1", 9.0, 9.0)]
    df = spark.createDataFrame([(None, "w1 w2 x"), (None, "w3 w5"), (7, "w4"), (7, "w6 w7"), (8, None), (9, "w1 w2 x")], "id long, text string")
    key = lambda d: sorted((r.id or -1, r.text or "", round(r.sentiment.polarity, 9), r.sentiment.subjectivity) for r in d.collect())
    small = key(EN.lexicon_sentiment(df, "text", lex, inline_limit=1000))
    assert key(EN.lexicon_sentiment(df, "text", lex)) == small
    table = EN.lexicon_df(spark, lex[:-1])
    assert key(EN.lexicon_sentiment(df, "text", table)) == small
    pol = MO.predict_polarity(df.where("id is not null"), ["id", "text"], "text", lambda d: MO.lexicon_logits(d, "chunk", table)).collect()
    assert len(pol) == 4


def test_empty_parameters(spark):
    df = spark.createDataFrame([(1, "a bug on pc")], "id long, text string")
    assert EN.lexicon_sentiment(df, "text", []).first().sentiment.polarity == 0.0
    row = df.select(K.keywords_found("text", []).alias("k"), K.detect_platform("text", {}).alias("p"),
                    K.detect_severity("text", {}).alias("s"), K.label_post("text", [], [], []).alias("l")).first()
    assert (row.k, row.p, row.s) == ([], ["unspecified"], "unspecified") and row.l == "Other"


def test_split_of_equal_keys_ends(spark):
    df = spark.createDataFrame([(1,)] * 40 + [(2,)] * 3, "k long")
    h = SA._hash_key(42, ["k"])
    assert SA.hash_threshold(df, h, 5, collect_limit=10) in {r[0] for r in df.select(h).distinct().collect()}
    assert SA.train_test_split(df, "k").where("split = 'test'").count() == 9  # ceil(0.2 * 43), also inside equal keys
    got = SA.train_test_split(df, "k", split_by="key").groupBy("k").agg(F.countDistinct("split").alias("n")).collect()
    assert all(r.n == 1 for r in got)


def test_keyword_paths_agree_on_null_ids_and_overlaps(spark):
    df = spark.createDataFrame([(None, "abcabc xy"), (None, "xyz"), (1, "ab"), (1, "ab"), (2, "")], "id long, text string")
    dic = spark.createDataFrame([("abc", "A"), ("ab", "B"), ("x", "C"), ("xyz", "D"), ("bca", "E"), ("ab", "F"), ("zz", "G")],
                                "keyword string, kind string")
    rows = lambda m: sorted(map(str, EN.match_keywords(df, ["id"], "text", dic, method=m).collect()))
    assert rows("broadcast") == rows("index") == rows("automaton")


def test_unicode_blanks(spark):
    df = spark.createDataFrame([(" [deleted] ",)], "t string")
    assert df.select(X.strip("t")).first()[0] == "[deleted]"
    assert df.select(X.sentence_pieces(F.lit("One. Two"))).first()[0] == ["One.", "Two"]


def test_posts_from_array_files_and_lines(spark, tmp_path):
    posts = [{"post_id": "a", "title": "x", "comments": [{"comment_id": "c", "text": "t"}]}, {"title": "no id", "comments": []}]
    (tmp_path / "array.json").write_text(json.dumps(posts, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, posts)) + "\nnot json\n")
    for name, skipped in (("array.json", 0), ("lines.json", 1)):
        path = str(tmp_path / name)
        found, comments = IO.read_posts(spark, path)
        assert found.count() == 2 and comments.count() == 1
        assert found.where("title = 'no id' and post_id like 'noid-%'").count() == 1
        assert IO.skipped_records(spark, path).count() == skipped


def test_keyword_index_beyond_the_filter(spark, monkeypatch):
    """Reduced fingerprints let more strings through, the join decides: same rows."""
    from threadscope.operators import fingerprints as FP
    texts = [(i, f"Text {i} naïve 🙂 key{i % 50} and key{i % 7}{i % 3} " + "pad " * (i % 40)) for i in range(200)] + [(None, None), (None, "key1")]
    df = spark.createDataFrame(texts, "id long, text string")
    dic = spark.createDataFrame([(f"KEY{i}",) for i in range(60)] + [("naïve 🙂",), ("🙂 k",), ("d",), ("",), ("pad " * 30,)], "keyword string")
    rows = lambda m: sorted(map(str, EN.match_keywords(df, ["id"], "text", dic, method=m).collect()))
    expected = rows("broadcast")
    assert rows("index") == expected and len(expected) > 300
    monkeypatch.setattr(FP, "FILTER_LIMIT", 20)
    monkeypatch.setattr(FP, "BATCH_CHARS", 100)
    assert rows("index") == expected
    assert EN.match_keywords(df, ["id"], "text", dic.limit(0), method="index").count() == 0
    assert EN.match_keywords(df.limit(0), ["id"], "text", dic, method="index").count() == 0


def test_windows_of_a_keyword_batch_are_bounded():
    """Fingerprints of all powers of two of a full batch, in bytes."""
    codes = np.zeros(FP.BATCH_CHARS, dtype="<u4")
    windows = FP.Windows(codes)
    windows.of(200)
    assert sum(x.nbytes for x in windows.levels.values()) <= 64 << 20
