"""Toxic spans, tokenizer alignment and the Merkle manifest against brute force, their SQL and defined edge cases."""

import bisect
import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from threadscope.llm import alignment, merkle, toxicity
from threadscope.llm.base import prepare
from threadscope.llm.bpe import byte_alphabet
from threadscope.llm.queries import ORACLES, QUERIES, piece_vocabulary, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, n_a long, score double, extra string"
TAIL = ("clash", 7, 0.5, "x")
EDGE = [(1, None, "en", "s", 0), (2, "", None, None, 0), (3, " \n\t", "en", "s", 3), (None, "one\ntwo", "en", "s", 13),
        (None, None, None, None, None), (4, "one two\nthree", "en", "s", 13), (4, "one two\nthree", "en", "s", 13), (4, "other", "de", "s", 5),
        (5, "w" * 5000, "en", None, 5000), (6, " ".join(f"word{i % 50}\n" for i in range(20000)), "de", "é", 0),
        (7, "x<|endoftext|>y</s><s>", "en", "t", 1), (8, "日本語 🙂\x00 naïve▁x  two  spaces ", "ja", "t", 1)]


@pytest.fixture(scope="module")
def edge(spark):
    prepare(spark)
    return spark.createDataFrame([(*r, *TAIL) for r in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    prepare(spark)
    return spark.createDataFrame([], SCHEMA)


# -- 11 toxic spans -------------------------------------------------------------------

def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    lengths = np.array([0, 1, 2, 7, 0, 10])
    e, trans = r.normal(size=lengths.sum()) * 3, np.exp(r.normal(size=(2, 2)))
    p, pairs = toxicity.forward_backward(e, lengths, trans, pairs=True)
    at, expected_pairs = 0, np.zeros((2, 2))
    for n in lengths:
        mass, total, seen = np.zeros(n), 0.0, np.zeros((2, 2))
        for path in range(2 ** n):
            y = [path >> i & 1 for i in range(n)]
            weight = np.prod([trans[a, b] * np.exp(e[at + i] * b) for i, (a, b) in enumerate(zip([0, *y], y))])
            total += weight
            mass += weight * np.array(y)
            for a, b in zip([0, *y], y):
                seen[a, b] += weight
        assert np.allclose(p[at:at + n], mass / total)
        expected_pairs += seen / total if n else 0
        at += n
    assert np.allclose(pairs, expected_pairs)


def test_blocks_do_not_change_marginals(monkeypatch):
    r = np.random.default_rng(2)
    lengths = np.array([300, 1, 128, 129, 1000])
    e, trans = r.normal(size=lengths.sum()) * 2, np.exp(r.normal(size=(2, 2)))
    p = toxicity.forward_backward(e, lengths, trans)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(p, toxicity.forward_backward(e, lengths, trans))


@pytest.fixture(scope="module")
def toxic_rows(spark):
    return QUERIES["op11_toxic_spans_crf"](spark, "/root/testdata/sf0.1").collect()


def test_op11_held_out_accuracy(spark, toxic_rows):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in toxic_rows)
    held = [(labels[r.doc_id], r.predicted, r.score) for r in toxic_rows if r.held_out and r.doc_id in labels]
    hit = sum(y and p for y, p, _ in held)
    assert hit >= 0.85 * sum(y for y, _, _ in held)
    assert hit >= 0.95 * sum(p for _, p, _ in held)
    assert all(0 <= s <= 1 and p == (s >= 0.7) for _, p, s in held)


def test_op11_spans_are_words(spark, toxic_rows):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()}
    found = collections.Counter(texts[r.doc_id][int(a):int(b)].lower() for r in toxic_rows if r.spans
                                for a, b in (s.split(":") for s in r.spans.split(",")))
    assert all(w == w.strip() and w for w in found)
    assert {"idiot", "stupid", "moron"} <= {w for w, n in found.most_common(30)}


@pytest.fixture(scope="module")
def small_chain():
    texts = [f"{w} day number {i} {'you stupid fool' if i % 2 else 'you kind friend'} said {w}" for i in range(90) for w in ("a", "the")]
    return toxicity.fit_chain(texts, np.array([i % 2 for i in range(90) for _ in "ab"]), {0: 0.5, 1: 0.5})


def test_op11_edges(spark, edge, empty, small_chain):
    rows = toxicity.tag(edge, small_chain).collect()
    assert len(rows) == len(EDGE) and rows[0].extra == "x" and rows[0].n_a == 7
    plain = rows[0].score
    assert rows[1].score == plain and rows[2].score == plain and all(not r.spans for r in rows[:3])
    assert rows[5].score == rows[6].score
    assert toxicity.tag(empty, small_chain).count() == 0
    assert {r.score for r in toxicity.tag(edge, None).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0)], "doc_id long, toxic int")
    assert toxicity.fit(edge, labels, F.col("doc_id").isNotNull()) is None
    assert toxicity.fit(empty, labels.limit(0), F.col("doc_id").isNotNull()) is None
    long = "word " * 200_000 + "stupid" + " word" * 200_000
    score, spans = toxicity.Tagger(small_chain).tag([long, "x" * 1_000_000, "you stupid fool"])
    assert spans[0] == [(1_000_000, 1_000_006)] and not spans[1] and score[2] >= 0.7 > score[1]


def test_op11_ignores_everything_but_text(spark, edge, small_chain):
    a = toxicity.tag(edge, small_chain).select("score").collect()
    b = toxicity.tag(edge.withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "doc_id": F.lit(1)}), small_chain).select("score").collect()
    assert a == b


# -- 12 alignment ---------------------------------------------------------------------

ENDS = st.lists(st.integers(1, 60), min_size=0, max_size=40, unique=True).map(sorted)


@given(ENDS, ENDS)
@settings(max_examples=300, deadline=None)
def test_gallop_is_rank(a, b):
    assert alignment.gallop(a, b) == [bisect.bisect_left(b, x) for x in a]


@given(ENDS, ENDS, st.integers(61, 70))
@settings(max_examples=300, deadline=None)
def test_intersect_gives_overlaps(a, b, end):
    a, b = np.array([*a, end]), np.array([*b, end])
    first, last, common_a, common_b = alignment.intersect(a, b)
    assert a[common_a].tolist() == b[common_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    starts_a, starts_b = [0, *a[:-1]], [0, *b[:-1]]
    for i, (x, y) in enumerate(zip(starts_a, a)):
        over = [j for j, (u, v) in enumerate(zip(starts_b, b)) if u < y and v > x]
        assert over == list(range(first[i], last[i] + 1))


def aligned_brute(rows):
    """op12 by pairs of byte ranges, one document at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    alphabet, a_coder = byte_alphabet(), Tokenizer.from_file(vocabulary())
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary())
    counts, docs = collections.Counter(), []
    for doc_id, text in rows:
        raw, a, b = b" " + (text or "").encode(), [], []
        if text:
            a = [(i, bytes(alphabet[c] for c in a_coder.id_to_token(i))) for i in a_coder.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode())
                 for i in b_coder.encode(text)]
            if not b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                a, b = [], []

        def ranges(tokens):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at := at + len(x)))
            return out

        ra, rb = ranges(a), ranges(b)
        links, j = [], 0
        for i, s, e in ra:
            while rb[j][2] <= s:
                j += 1
            k = j
            while k < len(rb) and rb[k][1] < e:
                links.append((i, rb[k][0]))
                k += 1
        common = sorted({e for *_, e in ra} & {e for *_, e in rb})
        groups = []
        for lo, hi in zip([0, *common], common):
            groups.append(",".join(str(i) for i, s, e in ra if lo < e <= hi) + "|" + ",".join(str(i) for i, s, e in rb if lo < e <= hi)
                          if len(text) < 3000 else None)
        counts.update(links)
        docs.append((doc_id, len(a), len(b), links, groups, len(common)))
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(d, na, nb, n, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest() if na else "")
            for d, na, nb, links, groups, n in docs]


def same_rows(got, expected):
    """Equal but for groups that the brute force left out because the text is long."""
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:7])
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert [r[:7] for r in got] == [r[:7] for r in expected]
    assert all(b[7] is None or a[7] == b[7] for a, b in zip(got, expected))


def test_op12_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    same_rows(QUERIES["op12_tokenizer_alignment"](spark, SF_SMALL).collect(), aligned_brute(rows))


def test_op12_edges(spark, edge, empty, monkeypatch):
    out = alignment.alignment(edge, vocabulary, piece_vocabulary)
    assert set(out.columns) == {*edge.columns, *alignment.COUNTS, "groups_sha256"} - {"text"}
    rows = out.select("doc_id", *alignment.COUNTS, "groups_sha256").collect()
    same_rows(rows, aligned_brute([(r[0], r[1]) for r in EDGE]))
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in rows)
    assert alignment.alignment(empty, vocabulary, piece_vocabulary).count() == 0
    groups = alignment.alignment(edge, vocabulary, piece_vocabulary, with_groups=True).where("doc_id = 7").first().groups
    assert "|" in groups and len(groups.split(";")) == [r.n_groups for r in rows if r.doc_id == 7][0]
    monkeypatch.setattr(alignment, "CHUNK_ROWS", 1)  # other chunks, same rows
    again = alignment.alignment(edge, vocabulary, piece_vocabulary).select("doc_id", *alignment.COUNTS, "groups_sha256").collect()
    same_rows(again, [tuple(r) for r in rows])


# -- 13 Merkle manifest ----------------------------------------------------------------

def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def proved_brute(rows, tampered):
    """op13 with lists; rows: (doc_id, source, lang, n_chars, text)."""
    def leaf(r, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r, leaf(r, r[4])))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {s: tree([x for _, x in by_source[s]]) for s in sources}
    top, out = tree([trees[s][-1][0] for s in sources]), []
    for ordinal, s in enumerate(sources):
        for place, (r, x) in enumerate(by_source[s]):
            fold, proof = leaf(r, tampered(r)), ""
            for levels, at in ((trees[s], place), (top, ordinal)):
                for level in levels[:-1]:
                    run, k = level[at // 3 * 3:at // 3 * 3 + 3], at % 3
                    proof += "".join(run[:k] + run[k + 1:])
                    fold, at = digest("".join([*run[:k], fold, *run[k + 1:]])), at // 3
            out.append((r[0], x, trees[s][-1][0], top[-1][0], digest(proof), fold, fold == top[-1][0]))
    return out


def contract_tampering(r):
    return r[4].replace("\n", "") if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_op13_equals_brute_force_and_sql(spark):
    got = QUERIES["op13_merkle_manifest"](spark, SF_SMALL).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*merkle.FIELDS).collect()]
    assert in_order(got) == in_order(proved_brute(rows, contract_tampering))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    assert in_order(got) == in_order(c.execute(ORACLES["op13_merkle_manifest"]).fetchall())
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("block", [4096, 2])
def test_op13_edges(spark, edge, empty, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)  # copies of a run near the root, one a block
    out = merkle.prove(edge, merkle.without_line_breaks())
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_a", "score", "extra", *merkle.ADDED]
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in EDGE]
    assert in_order(out.select("doc_id", *merkle.ADDED).collect()) == in_order(proved_brute(rows, contract_tampering))
    assert merkle.prove(empty).count() == 0
    one = merkle.prove(edge.where("doc_id = 5")).first()
    assert one.root == one.subroot == one.leaf == one.folded_root and one.verified and one.proof_sha256 == digest("")
    alone = merkle.prove(edge.where("doc_id in (4, 5, 6)").dropDuplicates(["source"]), F.lit("y")).collect()  # three sources of one row
    assert len(alone) == 3 and all(r.subroot == r.leaf and not r.verified for r in alone)
    single = merkle.prove(edge.where("source = 's'")).select("doc_id", *merkle.ADDED).collect()  # one source
    assert in_order(single) == in_order(proved_brute([r for r in rows if r[1] == "s"], lambda r: r[4]))


def test_op13_deep_tree(spark):
    rows = [(i, "hot" if i % 5 else f"s{i}", "en", 1, f"t{i}\n") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    prepare(spark)
    got = merkle.prove(docs, merkle.without_line_breaks()).select("doc_id", *merkle.ADDED).collect()
    assert in_order(got) == in_order(proved_brute(rows, contract_tampering))


def test_op13_runs_are_linked(spark, edge):
    rows = edge.withColumn("leaf", F.unhex(merkle.leaf_digest(F.col("text")))).withColumn("start", F.col("leaf")).drop("text")
    leaves, runs = merkle.manifest(rows)
    stored = {(r.run, r.block): r for r in runs.collect()}
    assert sum(r.parent is None for r in stored.values()) == 1
    for r in stored.values():
        if r.parent is not None:
            held = stored[r.parent, r.block].kids
            assert held[32 * r.slot:32 * r.slot + 32] == hashlib.sha256(bytes(r.kids).hex().encode()).digest()
    assert sorted(r.no for r in leaves.collect()) == list(range(len(EDGE)))
