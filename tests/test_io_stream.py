"""Readers/writers round trips and the streaming smoke test."""

import json

from pyspark.sql import functions as F

from threadscope.session import scratch_path
from threadscope.sources import posts_io as PIO
from threadscope.streaming.enrich_stream import run_enrichment


def test_u4_s2_tolerant_discussions(spark):
    path = scratch_path(spark, "t-disc")
    recs = [
        [{"title": "t", "comments": [{"text": "a"}, [{"text": "b"}, [{"text": "c"}]], "junk"]},
         "junk", {"x": 1}],
        {"comments": [[[{"text": "deep"}]]]},
    ]
    spark.createDataFrame([(json.dumps(r),) for r in recs], "value string").coalesce(1).write.text(path)
    posts, comments = PIO.read_discussions(spark, path)
    titles = sorted(r.title for r in posts.collect())
    assert titles == ["Discussion 1", "Discussion 3", "t"]
    by_post = {}
    for r in comments.collect():
        by_post.setdefault(r.post_id, []).append((r.pos, r.text))
    texts = sorted([t for _, t in sorted(v)] for v in by_post.values())
    assert texts == [["a", "b", "c"], ["deep"]]


def test_s1_s6_round_trip(spark):
    path = scratch_path(spark, "t-posts")
    posts = spark.createDataFrame([("p1", "T", "x"), ("p2", "U", None)], "post_id string, title string, text string")
    com = spark.createDataFrame([("p1", 1, "c2", "two"), ("p1", 0, "c1", "ünï")],
                                "post_id string, pos int, comment_id string, text string")
    PIO.write_posts_json(posts, com, path)
    p, c = PIO.read_posts(spark, path)
    assert sorted((r.post_id, r.text) for r in p.collect()) == [("p1", "x"), ("p2", None)]
    assert sorted((r.post_id, r.pos, r.comment_id, r.text) for r in c.collect()) == \
        [("p1", 0, "c1", "ünï"), ("p1", 1, "c2", "two")]


def test_f11_permissive(spark):
    path = scratch_path(spark, "t-bad")
    spark.createDataFrame([('{"post_id": "a", "title": "ok"}',), ('{"post_id": ',)], "value string") \
        .coalesce(1).write.text(path)
    p, _ = PIO.read_posts(spark, path)
    assert [r.post_id for r in p.collect()] == ["a"]


def test_s7_flatten(spark):
    df = spark.createDataFrame([("p", ["pc", "xbox"], [], ["bug", "fix"], (0.5, 0.1), True)],
                               "post_id string, platform array<string>, potential_games array<string>, "
                               "bug_keywords_found array<string>, sentiment struct<polarity double, subjectivity double>,"
                               " is_resolved boolean")
    r = PIO.flatten_posts(df).first().asDict()
    assert r == {"post_id": "p", "is_resolved": True, "platforms": "pc,xbox", "potential_games": "",
                 "bug_keywords": "bug,fix", "sentiment_polarity": 0.5, "sentiment_subjectivity": 0.1}


def test_streaming_enrichment_smoke(spark):
    src = scratch_path(spark, "t-stream-src")
    sink = scratch_path(spark, "t-stream-sink")
    spark.createDataFrame([(1, "Crash on PS5", "lag fix"), (2, "hello", "best game")],
                          "post_id long, title string, text string").write.parquet(src)
    schema = "post_id long, title string, text string"
    run_enrichment(spark, src, schema, sink)
    out = {r.post_id: r for r in spark.read.parquet(sink).collect()}
    assert out[1].label == "Bug" and out[1].platforms == "playstation" and out[1].severity == "critical"
    assert out[2].polarity > 0


def test_save_posts_unknown_format_raises(spark):
    import pytest
    posts = spark.createDataFrame([("p", "t")], "post_id string, title string")
    com = spark.createDataFrame([("p", 0, "c", "x")], "post_id string, pos int, comment_id string, text string")
    with pytest.raises(ValueError):
        PIO.save_posts(posts, com, scratch_path(spark, "t-x"), "xml")


def test_m13_write_report(spark):
    from threadscope.operators import summary as S
    posts = spark.createDataFrame([(1, "Hi"), (2, "Empty")], "post_id long, title string")
    com = spark.createDataFrame([(1, 0, "good stuff."), (1, 1, "more words here.")], "post_id long, pos int, text string")
    out = S.write_report(S.summarize(posts, com), scratch_path(spark, "t-report"), run_id="20240101_000000")
    assert out["processed_discussions"] == 2
    text = "\n".join(r.value for r in spark.read.text(out["text_dir"]).collect())
    assert "Discussion: Hi\n==\n" in text and "Total Comments: 0" in text
    rows = spark.read.option("header", True).option("sep", "\t").option("multiLine", True).csv(out["tsv_dir"])
    assert rows.columns == ["Title", "Total Comments", "Positive Comments", "Negative Comments",
                            "Neutral Comments", "Key Points"]


def test_s3_read_lines_strips(spark):
    from threadscope.sources import files as FI
    path = scratch_path(spark, "t-lines")
    spark.createDataFrame([("  Over/Under: r/ou \t",), ("X: No subreddit found",)], "value string") \
        .coalesce(1).write.text(path)
    lines = FI.read_lines(spark, path).orderBy("line_no").collect()
    assert [r.line for r in lines] == ["Over/Under: r/ou", "X: No subreddit found"]


def test_s4_s5_s8_s9_delimited_round_trips(spark):
    from threadscope.sources import files as FI
    m = spark.createDataFrame([("Precision", 0.5, 0.25)], "`Evaluation Metrics` string, Polarity double, Subjectivity double")
    mp = scratch_path(spark, "t-metrics")
    FI.write_delimited(m, mp, sep="\t")
    assert [tuple(r) for r in FI.read_metrics(spark, mp).collect()] == [("Precision", 0.5, 0.25)]
    t = spark.createDataFrame([('say "hi",\nthen go', 2), ("plain", 0)], "text string, label int")
    tp = scratch_path(spark, "t-train")
    FI.write_delimited(t, tp)
    assert sorted(tuple(r) for r in FI.read_training(spark, tp).collect()) == [("plain", 0), ('say "hi",\nthen go', 2)]


def test_s13_harvest_titles(spark):
    from threadscope.sources import files as FI
    pages = spark.createDataFrame([(1, "<h1> A title </h1><p>x</p><h1>B</h1>")], "page_id long, html string")
    assert [(r.k, r.title) for r in FI.harvest_titles(pages).collect()] == [(0, "A title"), (1, "B")]


def test_configure_for_scale(spark):
    from threadscope.session import configure_for_scale
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        conf = configure_for_scale(spark, 100 << 40)
        assert int(conf["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_quick_start_flow_from_post_files(spark):
    """README quick start: nested post file -> enrichment, counts, summary, report, CSV."""
    from threadscope.operators import enrich, stats
    from threadscope.operators import summary as S
    src = scratch_path(spark, "t-qs")
    rec = {"post_id": "p1", "title": "Game crashes on PS5", "text": "lag and freeze", "author": "a",
           "timestamp": "2024-01-02T03:04:05",
           "comments": [{"comment_id": "c1", "text": "Same here. Terrible bug.", "author": "b"},
                        {"comment_id": "c2", "text": "A patch fixed it for me!", "author": "a"}]}
    spark.createDataFrame([(json.dumps(rec),)], "value string").coalesce(1).write.text(src)
    posts, comments = PIO.read_posts(spark, src)
    rich = enrich.enrich_posts(posts)
    r = rich.first()
    assert r.label == "Bug" and r.platform == ["playstation"] and r.severity == "critical"
    assert str(r.created_ts) == "2024-01-02 03:04:05"
    assert [(x.severity, x.n) for x in stats.severity_counts(rich).collect()] == [("critical", 1)]
    rc = enrich.enrich_comments(comments, posts).orderBy("pos").collect()
    assert [x.is_op_response for x in rc] == [False, True] and rc[1].has_solution is True
    s = S.summarize(posts, comments).first()
    assert s.total_comments == 2 and s.negative == 1
    out = S.write_report(S.summarize(posts, comments), scratch_path(spark, "t-qs-rep"))
    assert out["processed_discussions"] == 1
    PIO.save_posts(rich, comments, scratch_path(spark, "t-qs-csv"), "csv")


def test_s3_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    from threadscope.sources import files as FI
    for name, n in (("a.txt", 3000), ("b with blank.txt", 10), ("empty.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("134217728", "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = FI.read_lines(spark, str(tmp_path)).collect()
            assert all(r.line.endswith(f" line {r.line_no}") for r in rows)
            seen.append(sorted((r.file, r.line_no) for r in rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(seen[0]) == 3010 and seen[0] == seen[1]


def test_s2_titles_and_ids_do_not_depend_on_splits(spark, tmp_path):
    lines = [json.dumps({"comments": [{"text": str(i)}]}) if i % 7 else "[1, {}]" if i else "" for i in range(500)]
    (tmp_path / "d.jsonl").write_text("\n".join([*lines, "{broken", "7"]))
    old, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("134217728", "2048"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            posts, comments = PIO.read_discussions(spark, str(tmp_path))
            rows = posts.join(comments, "post_id", "left").collect()
            seen.append(sorted((r.post_id, r.title, r.text or "") for r in rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen[0] == seen[1] and len(seen[0]) == len({p for p, *_ in seen[0]}) == 499
    titles = [t for _, t, x in sorted(seen[0], key=lambda r: int(r[0].split("#")[1])) if x]
    assert titles == [f"Discussion {i + 1}" for i in range(len(titles))]


def test_s2_pretty_arrays_and_lines_in_one_folder(spark, tmp_path):
    from threadscope.sources import discussions as DI
    entries = [{"title": "t", "comments": [[{"text": "a"}, 3]]}, "junk", {"comments": None}]
    (tmp_path / "pretty.json").write_text(json.dumps(entries, indent=4))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(e) for e in entries))
    (tmp_path / "one.json").write_text(json.dumps(entries[0], indent=4))
    (tmp_path / "looks.json").write_text('[{"title": "cut off"\n{"title": "line"}\n')
    found = DI.read(spark, str(tmp_path))
    assert sorted(r.title for r in found.posts.collect()) == ["Discussion 3", "Discussion 3", "line", "t", "t", "t"]
    assert [r.text for r in found.comments.collect()] == ["a"] * 3
    assert found.counts.first().asDict() == {"read": 6, "skipped": 3, "unexpected": 3}
    assert sorted(r.reason for r in found.skipped.collect()) == ["malformed", "no object", "no object"]


def test_u4_any_depth(spark, tmp_path):
    from threadscope.sources.discussions import parse_deep
    for depth in (1500, 50_000):
        text = '{"comments": ' + "[" * depth + '{"text": "x\\u00e9\\n", "n": [-1.5e3, true, null, {}]}, []' + "]" * depth + "}"
        (tmp_path / f"{depth}.json").write_text(text)
    posts, comments = PIO.read_discussions(spark, str(tmp_path))
    assert posts.count() == 2 and [r.text for r in comments.collect()] == ["xé\n"] * 2
    for good in ('{"a": [1, {"b": []}, "c"], "d": {}}', " [ ] ", '"x"', "-0.5", "[[], [[1]], false]"):
        assert parse_deep(good) == json.loads(good)
    for bad in ("", "[", "[1,]", "{1: 2}", '{"a" 1}', "[1] 2", '{"a": 1,}', "]", "[1 2]", "nul"):
        try:
            parse_deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_f11_one_scan_counts_and_lists(spark, tmp_path):
    lines = ['{"post_id": "a"}', "{broken", '{"title": "no id"}', '{"title": "no id"}', "also broken"]
    (tmp_path / "x.json").write_text("\n".join(lines))
    found = PIO.read_posts_counted(spark, str(tmp_path))
    assert (found.n_read, found.n_skipped) == (3, 2)
    assert sorted(r.record for r in found.skipped.collect()) == ["also broken", "{broken"]
    ids = [r.post_id for r in found.posts.collect()]
    assert len(set(ids)) == 3 and "a" in ids


def test_s1_mixed_folder_loses_nothing(spark, tmp_path):
    posts = [{"post_id": f"p{i}", "title": f"t{i}", "comments": [{"comment_id": f"c{i}"}]} for i in range(10)]
    (tmp_path / "array.json").write_text(json.dumps(posts[:5], indent=2))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, posts[5:])))
    found, comments = PIO.read_posts(spark, str(tmp_path))
    assert sorted(r.post_id for r in found.collect()) == [f"p{i}" for i in range(10)] and comments.count() == 10


def test_long_ids_do_not_go_with_every_word(spark):
    """Summaries of posts with text ids equal those of number ids, and only their 16-byte digests are shuffled with the words."""
    from threadscope.operators import summary as SU
    com = [(1, 0, "The game is great. It crashed twice"), (1, 1, "today. I love the map"), (2, 0, "Bad bug here."), (1, 2, "The game is great."), (3, 0, None)]
    posts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (3, "copy"), (4, "none"), (None, "null")], "post_id long, title string")
    comments = spark.createDataFrame(com, "post_id long, pos int, text string")
    long_id = F.concat(F.lit("file:/" + "x" * 200 + "#"), F.col("post_id").cast("string"))
    named = [d.withColumn("post_id", long_id) for d in (posts, comments)]
    for cluster in ("none", "kmeans"):
        plain = SU.summarize(posts, comments, cluster).withColumn("post_id", long_id)
        found = SU.summarize(*named, cluster)
        assert found.schema == plain.schema and sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    seen, steps = [], SU.summary_steps
    SU.summary_steps = lambda p, c, *a, **k: seen.append(c) or steps(p, c, *a, **k)
    try:
        SU.summarize(*named)
    finally:
        SU.summary_steps = steps
    assert seen[0].select(F.max(F.length("post_id"))).first()[0] == 16
