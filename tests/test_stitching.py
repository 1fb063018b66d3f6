"""Ordered concatenation in buckets (A9, X21), sentences by their source (J3), a trained scorer (M5)."""

import random
import re

import pytest
from pyspark.sql import functions as F

from threadscope.operators import enrich as EN
from threadscope.operators import softmax as SM
from threadscope.operators import summary as S

COMMENTS = "post_id int, pos int, text string"
LEX = [("good", 1.0, 0.5), ("bad", -1.0, 0.5)]


def test_concat_ordered_for_any_bucket_width(spark):
    rng = random.Random(3)
    rows = [(p, i, rng.choice(["", "x", "yy", "é z", None])) for p in range(4) for i in range(rng.randrange(1, 40))]
    rows += [(9, 0, None), (9, 7, None), (8, 0, None), (8, 5, "a"), (8, 5, "a")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, COMMENTS)
    want = {p: " ".join(t for _, t in sorted((i, t) for q, i, t in rows if q == p and t is not None)) for p in {r[0] for r in rows}}
    for width in (1, 3, 1000):
        assert {r.post_id: r.all_text for r in S.discussion_text(df, width).collect()} == want
    assert S.discussion_text(df.where("false")).count() == 0


def test_joined_text_past_the_limit_fails_with_its_size(spark):
    df = spark.createDataFrame([(1, i, "abcd") for i in range(10)] + [(2, 0, "abcd")], COMMENTS)
    with pytest.raises(Exception, match="exceeds 49 bytes: 50 bytes at .*post_id.*1"):
        S.discussion_text(df, 3, max_bytes=49).collect()
    assert S.discussion_text(df, 3, max_bytes=50).count() == 2


def test_discussion_without_marks_is_joined_in_buckets(spark):
    rows = [(1, i, f"word{i}") for i in range(200)]
    st = S.summary_steps(spark.createDataFrame([(1, "t")], "post_id int, title string"),
                         spark.createDataFrame(rows, COMMENTS), LEX, bucket_width=7)
    assert [r.sentence for r in st.sentences.collect()] == [" ".join(t for _, _, t in rows)]
    plan = spark._jvm.PythonSQLUtils.explainString(
        S.discussion_text(spark.createDataFrame(rows, COMMENTS))._jdf.queryExecution(), "formatted")
    assert re.search(r"Exchange\n.*\n.*hashpartitioning\(post_id#\d+, _bucket", plan)


def by_source(texts):
    """Sentences of the joined text with the index of the comment that holds their first character."""
    joined, owner = "", []
    for i, t in enumerate(texts):
        joined += t + " "
        owner += [i] * (len(t) + 1)
    out, start = [], 0
    for m in [*re.finditer(r"(?<=[.!?])\s+", joined), None]:
        piece = joined[start:m.start() if m else len(joined)]
        if piece.strip():
            out.append((piece.strip(), owner[start + len(piece) - len(piece.lstrip())]))
        start = m.end() if m else start
    return out


def test_sentences_by_source_against_brute_force(spark):
    rng = random.Random(11)
    posts = [["".join(rng.choice(["good", "bad", "x", ".", "!", " ", "  "]) for _ in range(rng.randrange(0, 12)))
              for _ in range(rng.randrange(1, 8))] for _ in range(60)]
    rows = [(p, i, t) for p, texts in enumerate(posts) for i, t in enumerate(texts)]
    st = S.summary_steps(spark.createDataFrame([(p, "t") for p in range(60)], "post_id int, title string"),
                         spark.createDataFrame(rows, COMMENTS), LEX, align="source", bucket_width=2)
    got = {}
    for r in st.aligned.orderBy("post_id", "sid").collect():
        got.setdefault(r.post_id, []).append((r.sentence, r.src))
    assert got == {p: s for p, texts in enumerate(posts) if (s := by_source(texts))}
    counts = {r.post_id: r.total_comments for r in st.distribution.collect()}
    assert counts == {p: len(posts[p]) for p in got}


def test_unknown_alignment_is_an_error(spark):
    none = spark.createDataFrame([], COMMENTS)
    with pytest.raises(ValueError, match="alignment"):
        S.summary_steps(none, none, align="title")


def test_trained_scorer_labels_comments(spark):
    train = spark.createDataFrame([("good fine", 2), ("good day", 2), ("bad poor", 0), ("bad day", 0), ("so so", 1), ("so it", 1)] * 3,
                                  "text string, label int")
    scorer = SM.train(train, epochs=40).scorer()
    df = spark.createDataFrame([(1, "good good", "a", 1.0), (2, "bad", "b", 2.0), (3, "so", "c", 3.0), (4, None, "d", 4.0)],
                               "id int, text string, chunk string, logits double")
    got = {r.id: r for r in EN.label_sentiment(df, "text", scorer=scorer).collect()}
    assert [got[i].sentiment_label.label for i in (1, 2, 3, 4)] == ["positive", "negative", "neutral", "neutral"]
    assert all(1 / 3 < got[i].sentiment_label.score <= 1 for i in (1, 2, 3)) and got[4].sentiment_label.score == 0.0
    assert [got[i].chunk for i in (1, 2, 3, 4)] == list("abcd") and got[3].logits == 3.0
    failed = EN.label_sentiment(df, "text", scorer=lambda d: d.withColumn("logits", F.lit(None).cast("array<double>")))
    assert {tuple(r.sentiment_label) for r in failed.collect()} == {("neutral", 0.0)}
    posts = spark.createDataFrame([(1, "t")], "post_id int, title string")
    com = spark.createDataFrame([(1, 0, "Good good."), (1, 1, "Bad bad.")], COMMENTS)
    row = S.summarize(posts, com, scorer=scorer, align="source").first()
    assert (row.total_comments, row.positive, row.negative) == (2, 1, 1)
