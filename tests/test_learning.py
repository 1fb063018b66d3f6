"""Random indexing, softmax regression, k-means with a hot group, metrics in one pass."""

import math
import re
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadscope.operators import embeddings as EM
from threadscope.operators import evaluate as EV
from threadscope.operators import models as MO
from threadscope.operators import softmax as SM


def random_index_brute(sentences, dim=100, window=5):
    def entries(w):
        for j in range(4):
            v = int(md5(w.encode()).hexdigest()[8 * j:8 * j + 8], 16)
            yield v % dim, 1 if v // dim % 2 == 0 else -1

    sums = defaultdict(lambda: [0] * dim)
    for s in sentences:
        for i, w in enumerate(s):
            for o in s[max(0, i - window):i] + s[i + 1:i + 1 + window]:
                for d, sign in entries(o):
                    sums[w][d] += sign
    unit = {w: [math.floor(x * 1e6 / math.sqrt(sum(y * y for y in v)) + 0.5) for x in v] for w, v in sums.items() if any(v)}
    return [[sum(unit[w][d] for w in s if w in unit) / (len(s) * 1e6) if s else 0.0 for d in range(dim)] for s in sentences]


SENTENCES = [["a", "b", "c", "a"], ["lonely"], [], ["a", "b"], [f"w{i % 7}" for i in range(300)], ["x", "y", "a"]]


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_random_indexing_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(EM, "BROADCAST_BYTES", limit)  # both ways of meeting the word vectors
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "id int, tokens array<string>")
    got = {r.id: r.vector for r in EM.sentence_vectors(df, ["id"]).collect()}
    for i, v in enumerate(random_index_brute(SENTENCES)):
        assert got[i] == pytest.approx(v, abs=1e-12)
    assert not any(got[1]) and not any(got[2])


def test_similar_words_are_near(spark):
    rows = [(i, f"the {a} sat on a {b}".split()) for i, (a, b) in enumerate([("cat", "mat"), ("dog", "mat"), ("cat", "rug"), ("dog", "rug")])]
    rows += [(9, "prices rose in march".split())]
    v = {r.word: r.vector for r in EM.word_vectors(spark.createDataFrame(rows, "id int, tokens array<string>")).collect()}
    cos = lambda x, y: sum(a * b for a, b in zip(v[x], v[y])) / 1e12
    assert cos("cat", "dog") > 0.9 > abs(cos("cat", "prices")) + 0.4


def test_very_long_sentence(spark):
    df = spark.createDataFrame([(1, [f"w{i % 50}" for i in range(100_000)])], "id int, tokens array<string>")
    assert len(EM.sentence_vectors(df, ["id"]).first().vector) == 100


def test_word2vec_stays_an_option(spark):
    a = spark.createDataFrame([(1, s, f"alpha beta {w} gamma") for s, w in enumerate(["one", "two", "three"])], "post_id long, sid long, sentence string")
    for embedding in ("random_index", "word2vec"):
        rows = MO.cluster_sentences(a, stop_words=["the"], embedding=embedding, k_max=2).collect()
        assert len(rows) == 3 and {r.cluster for r in rows} <= {0, 1}
    with pytest.raises(ValueError):
        MO.cluster_sentences(a, embedding="other")


def test_corpus_topics(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 10, 1.0]) for i in range(20)], "id int, vector array<double>")
    rows = MO.kmeans_corpus(df, k=2).collect()
    assert len({(r.id % 2, r.topic) for r in rows}) == 2


def test_softmax_learns_and_reports_each_epoch(spark):
    words = {0: "awful broken bad", 1: "normal plain table", 2: "great lovely fine"}
    rows = [(f"{words[i % 3].split()[i // 3 % 3]} thing number {i}", i % 3) for i in range(90)] + [(None, 1), ("out of range", 7)]
    df = spark.createDataFrame(rows, "text string, label int")
    model = SM.train(df, epochs=60)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:])) and model.losses[0] == pytest.approx(math.log(3))
    metrics = SM.evaluate_epochs(model, df.where("label < 3")).orderBy("epoch").collect()
    assert [r.epoch for r in metrics] == list(range(1, len(model.epochs) + 1)) and metrics[-1].accuracy == 1.0
    pol = MO.predict_polarity(spark.createDataFrame([(1, "great lovely"), (2, "awful"), (3, "")], "id int, text string"), ["id"], "text",
                              scorer=model.scorer(), size=4, overlap=2)
    assert {r.id: r.polarity for r in pol.collect()}[1] == 1
    with pytest.raises(ValueError):
        SM.train(df.where("label > 3"))


def test_softmax_gradient_is_the_loss_slope(spark):
    """One step from zero equals the numeric slope of the mean loss."""
    rows = [("a a b", 0), ("b c", 1), ("a c c c", 2)]
    df = spark.createDataFrame(rows, "text string, label int")
    w = SM.train(df, epochs=1, rate=1.0, reg=0.0, num_features=64).epochs[0]

    def loss(w):
        total = 0.0
        for text, y in rows:
            n = Counter(int(md5(t.encode()).hexdigest()[:8], 16) % 64 for t in text.split())
            root = math.sqrt(sum(c * c for c in n.values()))
            z = [w[c] + sum(k * w[3 * (i + 1) + c] for i, k in n.items()) / root for c in range(3)]
            total += math.log(sum(map(math.exp, z))) - z[y]
        return total / len(rows)

    zero = [0.0] * len(w)
    for at in [0, 2, *[i for i, v in enumerate(w) if v][:12]]:
        step = [1e-6 if i == at else 0.0 for i in range(len(w))]
        slope = (loss(step) - loss([-s for s in step])) / 2e-6
        assert w[at] == pytest.approx(zero[at] - slope, abs=1e-6)


def test_kmeans_hot_group_is_salted(spark, monkeypatch):
    points = [("hot" if i % 3 else f"g{i % 40}", i, [float(i % 7), float(i % 11)]) for i in range(600)]
    df = spark.createDataFrame(points, "g string, id long, v array<double>")
    plain = sorted(MO.kmeans_per_group(df, "g", "id", "v").collect())
    monkeypatch.setattr(MO, "SALT_ROWS", 50)
    assert sorted(MO.kmeans_per_group(df, "g", "id", "v").collect()) == plain
    seen = Counter()
    real = F.pmod
    monkeypatch.setattr(MO.F, "pmod", lambda a, b: seen.update(["salted"]) or real(a, b))
    MO.kmeans_per_group(df, "g", "id", "v", max_iter=1)
    assert seen["salted"]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + \
        df._jdf.queryExecution().executedPlan().toString().count("Exchange SinglePartition")


def test_e5_takes_two_exchanges(spark):
    pairs = spark.createDataFrame([(1, 0, 1, 1), (0, 0, 1, -1)], "actual int, predicted int, actual_subj int, predicted_subj int")
    table = EV.metrics_table(pairs)
    assert exchanges(table) == 2
    rows = {r["Evaluation Metrics"]: (r.Polarity, r.Subjectivity) for r in table.collect()}
    assert rows["Accuracy"] == (0.5, 0.5) and rows["Precision"] == (0.25, 0.5)


def test_metrics_by_key_equal_metrics_of_each(spark):
    rows = [(m, i % 3, (i * k) % 3) for m, k in (("a", 1), ("b", 2), ("c", 5)) for i in range(50)]
    df = spark.createDataFrame(rows, "model string, actual int, predicted int")
    for weighted, single in ((False, EV.macro_metrics), (True, EV.weighted_metrics)):
        both = {r.model: tuple(r)[1:] for r in EV.metrics_by(df, ["model"], weighted=weighted).collect()}
        for m in "abc":
            assert both[m] == pytest.approx(tuple(single(df.where(F.col("model") == m)).first()))


def test_labelled_pairs_need_both_sides(spark):
    schema = "post_id string, sentiment struct<polarity double, subjectivity double, `actual polarity`: double, `actual subjectivity`: double>"
    posts = spark.createDataFrame([("p", (0.3, 0.1, 1.0, None)), ("q", None), ("r", (None, 0.5, 1.0, 1.0))], schema)
    comments = spark.createDataFrame([("p", (-0.2, 0.0, -1.0, 0.0))], schema)
    rows = sorted(tuple(r) for r in EV.labelled_pairs(posts, comments).collect())
    assert rows == [("comment", "Polarity", -1, -1), ("comment", "Subjectivity", 0, 0), ("post", "Polarity", 1, 1), ("post", "Subjectivity", 1, 1)]


def test_w7_border_inside_equal_keys(spark):
    from threadscope.operators import sampling as SA
    rows = [("same", i) for i in range(40)] + [("other", i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = SA.train_test_split(df, "k", 0.2).collect()
    assert Counter(r.split for r in got) == {"test": 9, "train": 34} and sorted((r.k, r.v) for r in got) == sorted(rows)
    whole = SA.train_test_split(df, "k", 0.5, split_by="key").collect()
    assert len({(r.k, r.split) for r in whole}) == 2 and {r.split for r in whole} == {"test", "train"}
    assert SA.train_test_split(df.limit(0), "k").count() == 0


def test_w7_posts_keep_their_comments(spark):
    from threadscope.operators import sampling as SA
    posts = spark.createDataFrame([(f"p{i}",) for i in range(30)], "post_id string")
    comments = spark.createDataFrame([(f"p{i % 30}", i) for i in range(300)], "post_id string, pos int")
    p, c = SA.split_posts(posts, comments)
    side = {r.post_id: r.split for r in p.collect()}
    assert Counter(side.values())["test"] == 6 and all(side[r.post_id] == r.split for r in c.collect())


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_kmeans_steps_do_not_shuffle_points(spark, monkeypatch):
    """Small groups are clustered whole in a task after one shuffle; larger ones meet broadcast centroids; labels agree."""
    points = [(f"g{i % 7}", i, [float(i * 37 % 101), float(i * 53 % 89)]) for i in range(400)] + [("one", 1000, [1.0, 2.0])]
    df = spark.createDataFrame(points, "g string, id long, v array<double>")
    small = MO.kmeans_per_group(df, "g", "id", "v")
    assert "MapInArrow" in plan_of(small) and plan_of(small).count("Exchange") == 1
    monkeypatch.setattr(MO, "SMALL_GROUP", 0)
    large = MO.kmeans_per_group(df, "g", "id", "v")
    assert "SortMergeJoin" not in plan_of(large)
    assert sorted(small.collect()) == sorted(large.collect())
    monkeypatch.setattr(MO, "SMALL_GROUP", 50)  # groups of both kinds, and a row without a group
    odd = df.union(spark.createDataFrame([(None, 2000, [1.0, 1.0]), ("one", 1001, [3.0, 2.0])], df.schema))
    assert len(MO.kmeans_per_group(odd, "g", "id", "v").collect()) == 402


def test_windows_do_not_carry_the_whole_text(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200)))], "id int, text string")
    w = MO.windows(df, ["id"], "text", 64, 32)
    kept = re.findall(r"Generate posexplode\(.*\), \[([^\]]*)\], false", plan_of(w))
    assert kept and not any("_t#" in k for k in kept)
    got = {r.w: r.chunk for r in w.collect()}
    assert got == {i: [f"w{j}" for j in range(32 * i, min(32 * i + 64, 200))] for i in range(6)}


def test_words_are_hashed_once_a_batch(monkeypatch):
    import pyarrow as pa
    calls = []
    real = SM.md5
    monkeypatch.setattr(SM, "md5", lambda b: calls.append(b) or real(b))
    numbers, row, root = SM.numbered(pa.array([["a"] * 300, ["b", "a", "a"], [], None], pa.list_(pa.string())), 64)
    a, b = (int(md5(w).hexdigest()[:8], 16) % 64 for w in (b"a", b"b"))
    assert sorted(calls) == [b"a", b"b"]
    assert numbers.tolist() == [a] * 300 + [b, a, a] and row.tolist() == [0] * 300 + [1] * 3
    assert root.tolist() == [300.0, math.sqrt(5) if a != b else 3.0, 1.0, 1.0]


def test_word2vec_trains_in_blocks_and_its_vectors_stay_in_tables(spark, monkeypatch):
    from threadscope.operators import word2vec as W2V
    monkeypatch.setattr(W2V, "BLOCK_TOKENS", 4000)
    rng = np.random.default_rng(1)
    topics = [[f"{t}{i}" for i in range(8)] for t in "ab"]
    rows = [(list(rng.choice(topics[i % 2], 10)),) for i in range(1200)] + [(["alone"],), ([None, "rare"],), ([],), (None,), (["long"] * 2500,)]
    model = MO.fit_word2vec(spark.createDataFrame(rows, "tokens array<string>"), "tokens", vector_size=16, num_partitions=2)
    table = model.getVectors()
    assert "LocalRelation" not in table._jdf.queryExecution().optimizedPlan().toString()  # nothing came from the driver
    v = {r.word: r.vector.toArray() for r in table.collect()}
    assert set(v) == {*topics[0], *topics[1], "alone", "rare", "long"} and model.getVectorSize() == 16
    assert all(len(x) == 16 and np.isfinite(x).all() and x.any() for x in v.values())
    cos = lambda x, y: v[x] @ v[y] / np.linalg.norm(v[x]) / np.linalg.norm(v[y])
    same = np.mean([cos(x, y) for t in topics for x in t for y in t if x < y])
    other = np.mean([cos(x, y) for x in topics[0] for y in topics[1]])
    assert same > other + 0.3
    few = MO.fit_word2vec(spark.createDataFrame(rows, "tokens array<string>"), "tokens", vector_size=4, min_count=2, max_iter=1)
    assert {r.word for r in few.getVectors().collect()} == {*topics[0], *topics[1], "long"}


def test_word2vec_pairs_and_batches():
    from threadscope.operators import word2vec as W2V
    rng = np.random.default_rng(0)
    words, sentence = np.arange(7), np.array([0, 0, 0, 0, 2, 5, 5])
    centre, context = W2V.pairs(words, sentence, 1, rng)
    assert sorted(zip(centre.tolist(), context.tolist())) == [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (5, 6), (6, 5)]
    assert all(len(x) == 0 for x in W2V.pairs(words[:1], sentence[:1], 5, rng))
    to = np.zeros((3, 2))
    W2V._add(to, np.array([2, 0, 2]), np.array([[1, 2], [3, 4], [5, 6]]))
    assert to.tolist() == [[3, 4], [0, 0], [6, 8]]


def test_sentence_without_known_word_is_zero(spark):
    df = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["alone"]), (3, []), (4, None), (5, ["alpha"] * 40)], "id long, tokens array<string>")
    model = MO.fit_word2vec(df, "tokens", vector_size=12)
    assert "LocalRelation" not in MO.sentence_vectors(df, ["id"], "tokens", model)._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.vector for r in MO.sentence_vectors(df, ["id"], "tokens", model).collect()}
    assert {len(v) for v in got.values()} == {12} and {i for i, v in got.items() if not any(v)} == {3, 4}
