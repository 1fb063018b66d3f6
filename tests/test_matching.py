"""Names by segments (J1) and mentions with types (M8) against brute force."""

import random
import re

from threadscope.operators import matching as M


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(n)]


def test_match_names_is_exact_for_any_hot_bound(spark):
    titles, names = _words(120, 1) + ["same", "a", ""], _words(60, 2) + ["same", "A!", "a"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate([*titles, None])], "id int, title string")
    c = spark.createDataFrame([(x,) for x in [*names, None]], "name string")

    def norm(x):
        return "".join(ch for ch in x if ch.isalnum()).lower()
    expected = {}
    for i, title in enumerate(titles):
        best = min(((edits(norm(title), norm(n)), n) for n in names if norm(n) and edits(norm(title), norm(n)) <= 2), default=None)
        expected[i] = (best[1], best[0]) if best else (None, None)
    expected[len(titles)] = (None, None)
    for hot in (0, 3, 1000):
        assert {r.id: (r.match, r.distance) for r in M.match_names(t, c, 2, hot=hot).collect()} == expected


def test_segments_hold_few_candidates(spark):
    """Where names share a beginning, candidates stay near the number of true pairs."""
    names = spark.createDataFrame([(f"customer{i * 7919 % 100000:05d}",) * 2 for i in range(400)], "_cn string, match string")
    titles = names.selectExpr("concat(_cn, 'x') AS _tn")
    pairs = M.name_candidates(titles, names, 1, hot=20).select("_tn", "_cn").distinct()
    assert pairs.where("levenshtein(_tn, _cn) <= 1").count() == 400
    assert pairs.count() < 4 * 400


def test_keys_of_names_are_not_broadcast(spark, tmp_path):
    """Files say nothing of how many keys their names become, so no table of keys may be sent through the driver."""
    rows = [(f"shared beginning {i * 7919 % 100000:05d}",) for i in range(300)]
    spark.createDataFrame(rows, "name string").write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    titles = names.selectExpr("concat(name, 'x') AS title")
    pairs = M.name_candidates(titles.selectExpr("title AS _tn"), names.selectExpr("name AS _cn", "name AS match"), 2, hot=20)
    got = M.match_names(titles, names)
    for df in (pairs, got):
        assert "Broadcast" not in spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert {(r.title[:-1], r.distance) for r in got.collect() if r.match == r.title[:-1]} == {(n, 1) for n, in rows}


def test_match_names_empty(spark):
    none = spark.createDataFrame([], "title string, match string")
    got = M.match_names(none.select("title"), none.selectExpr("title AS name"))
    assert got.columns == ["title", "match", "distance"] and got.count() == 0
    one = spark.createDataFrame([("x",)], "title string")
    assert [tuple(r) for r in M.match_names(one, none.selectExpr("title AS name")).collect()] == [("x", None, None)]


def brute_mentions(words, entries):
    at, out = 0, []
    while at < len(words):
        n = max((len(e) for e in entries if tuple(words[at:at + len(e)]) == e), default=0)
        if n:
            out += [(at, n, name, kind) for name, kind in entries[tuple(words[at:at + n])]]
        at += max(n, 1)
    return sorted(out)


def test_typed_mentions_take_the_longest_of_the_first(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    gaz = [("A b", "X"), ("b c d", "Y"), ("a", "Z"), ("c-d", "X"), ("c d", "Y"), ("d a b c", "X"), ("...", "X"), (None, "X"), ("d d", None)]
    entries = {}
    for name, kind in gaz:
        if name and kind and any(c.isalnum() for c in name):
            entries.setdefault(tuple(name.lower().replace("-", " ").split()), []).append((name.lower(), kind))
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "id int, text string")
    g = spark.createDataFrame(gaz, "name string, type string")
    for limit in (M.FIRST_WORD_LIMIT, 0):
        rows = M.typed_mentions(df, "id", "text", g, first_word_limit=limit).collect()
        for i, text in enumerate(texts):
            got = sorted((r.place, r.n_words, r.mention, r.type) for r in rows if r.id == i)
            assert got == brute_mentions(text.split(), entries)
        kept = M.typed_mentions(df, "id", "text", g, ("X",), first_word_limit=limit).collect()
        assert sorted(kept) == sorted(r for r in rows if r.type == "X")


def test_mentions_do_not_depend_on_the_first_word_limit(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "c b a"), (3, None)], "id int, text string")
    g = spark.createDataFrame([("a b",), ("c",), ("B",)], "name string")
    got = [sorted(M.entity_mentions(df, "id", "text", g, first_word_limit=n).collect()) for n in (0, 100)]
    assert got[0] == got[1] and [tuple(r) for r in got[0]] == [(1, ["a b", "b", "c"]), (2, ["b", "c"])]


def test_no_text_in_a_shuffle_of_mentions(spark):
    df = spark.createDataFrame([(1, "a b c")], "id int, text string")
    g = spark.createDataFrame([("a b",), ("c",)], "name string")
    got = M.entity_mentions(df, "id", "text", g, first_word_limit=0)
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"\) Exchange\n(Input [^\n]*)", plan)
    assert inputs and not [x for x in inputs if "_t#" in x or "text#" in x]
