"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line with a word goes if an equal line stands earlier in the corpus (by document id, then line
number).  A line of MIN_WORDS words or more also goes if an earlier line of that length
is within one word insertion, deletion or substitution of it.  Lines are compared as word sequences.

1. Lines are hashed; equal lines become one, at its earliest place.
2. With one edit, two lines are equal outside one of four blocks.  Every line is looked
   up without each of its blocks; only blocks that leave something other lines have
   too can hold an edit, and lines without such a block take no further part.
3. The others emit the line itself and every variant with one word of an open block
   deleted, each as a hash.  A variant's hash is an exclusive-or of word hashes tagged with their
   places, so running exclusive-ors give all variants in linear time.
4. Equal variants meet: two lines that delete the same place are a substitution
   apart, a line that equals another's variant a deletion.  Every key is reduced to
   its earliest line first, and each line is joined with that one only, so a key
   that very many lines share costs rows in proportion to them.
5. Links are verified on the words themselves.

Defined results: a null text stays null and has no lines; an empty text has one
empty line; lines without a word always stay; rows equal in id and text are judged alike, and
null ids count as earliest.  Input columns are returned unchanged but for the text;
names that clash with the columns added here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import hash128, materialize

#: Lines of fewer words go only if they equal an earlier one: one word of so few is no small edit.
MIN_WORDS = 8
#: Blocks of a line, and the step of the lengths they are counted from (at most MIN_WORDS).
BLOCKS, STEP = 4, 8
#: Words of one block of the running exclusive-ors.
BLOCK = 32


def plain(text: Column) -> Column:
    """A text with one blank for every run of them inside a line; only texts that have others are rewritten."""
    other = text.contains("  ")
    for blank in "\t\x0B\f\r":
        other = other | text.contains(blank)
    return F.when(other, F.regexp_replace(text, r"[\x20\t\x0B\f\r]+", " ")).otherwise(text)


def block_spans(n: Column) -> list[tuple[Column, Column, Column]]:
    """(applies, words before, words after) of the gaps that a line of n words is looked
    up by.  A line and one with a word more count their gaps from the same length
    (a multiple of STEP below both; a line at a multiple counts from both), and every
    place lies in the gap between the first and the last words of some block."""
    out = []
    for base, applies in ((n - n % STEP, F.lit(True)), (n - STEP, (n % STEP == 0) & (n > STEP))):
        for q in range(BLOCKS):
            before = F.floor(base * q / BLOCKS).cast("int")
            out.append((applies, before, (base - F.floor(base * (q + 1) / BLOCKS)).cast("int")))
    return out


def with_gap_keys(lines: DataFrame) -> DataFrame:
    """``gaps``: hashes of a line's ``words`` without each of its gaps, in the order of ``block_spans``; null for fewer than MIN_WORDS.

    Blocks have equally many words (STEP is a multiple of BLOCKS), so the words before a gap are whole blocks counted from
    the line's start, those after it whole blocks counted from its end: each block is hashed once, not once a gap."""
    n, sizes = F.col("n"), {"usual": "block", "more": "block_more"}
    block = ((n - n % STEP) / BLOCKS).cast("int")
    lines = lines.withColumns({"block": block, "block_more": F.when((n % STEP == 0) & (n > STEP), block - STEP // BLOCKS).otherwise(0)})
    for name, b in sizes.items():
        lines = lines.withColumns({f"{name}{k}": F.xxhash64(F.slice("words", start, F.col(b))) for k, start in enumerate(
            [F.col(b) * k + 1 for k in range(BLOCKS - 1)] + [n - F.col(b) * k + 1 for k in range(BLOCKS - 1, 0, -1)])})
    usual, more = (F.array(*[F.xxhash64(F.lit(q), *[f"{name}{k}" for k in [*range(q), *range(BLOCKS - 1 + q, 2 * BLOCKS - 2)]])
                             for q in range(BLOCKS)]) for name in sizes)
    gaps = F.when(n >= MIN_WORDS, F.when(F.col("block_more") > 0, F.concat(usual, more)).otherwise(usual))
    return lines.withColumn("gaps", gaps)


def bound(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``value`` computed once (an alias would be copied into
    lambdas and computed again for each element)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running_xor(values: str, x: str) -> str:
    """SQL: exclusive-or of all elements before each, then of all; by blocks, so linear in the length."""
    scan = "aggregate({}, array(0L), (acc, v) -> concat(acc, array(element_at(acc, -1) ^ v)))"
    inner = (f"transform(sequence(0, cast(floor((size({values}) - 1) / {BLOCK}) as int)), "
             f"b -> {scan.format(f'slice({values}, b * {BLOCK} + 1, {BLOCK})')})")
    offsets = scan.format(f"transform({x}, part -> element_at(part, -1))")
    shifted = f"flatten(transform({x}, (part, b) -> transform(slice(part, 1, size(part) - 1), v -> v ^ {x}o[b])))"
    return bound(inner, x, bound(offsets, f"{x}o", f"concat({shifted}, array(element_at({x}o, -1)))"))


def variant_rows(found: DataFrame) -> DataFrame:
    """(id, at, hash, place) of each line itself (place 0) and of its one-word deletions at ``places`` (from 1).

    Hashes tell lengths apart, as a place's tag is part of each word's hash.  The variants are exploded as they are
    computed: of a column, Spark infers a filter on its size, which computes them all again."""
    each = ("transform(places, i -> named_struct('place', i, 'hash', "
            "pa[i - 1] ^ element_at(pb, -1) ^ pb[i]))")
    whole = "concat(array(named_struct('place', 0, 'hash', element_at(pa, -1))), " + each + ")"
    tagged = {"a": "transform(words, (w, j) -> xxhash64(w, j))", "b": "transform(words, (w, j) -> xxhash64(w, j - 1))"}
    for c in "ba":
        whole = bound(tagged[c], f"t{c}", bound(running_xor(f"t{c}", f"x{c}"), f"p{c}", whole))
    return found.select("id", "at", F.explode(F.expr(whole)).alias("v")).select("id", "at", "v.hash", "v.place")


def without(words: Column, place: Column) -> Column:
    """The words without the one at a place (0: all)."""
    n = F.size(words)
    return F.when(place == 0, words).otherwise(
        F.concat(F.slice(words, F.lit(1), F.greatest(place - 1, F.lit(0))),
                 F.slice(words, F.greatest(place + 1, F.lit(1)), F.greatest(n - place, F.lit(0)))))


def near_lines(lines: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(id) of the distinct lines of which an earlier line is one edit away.

    ``lines``: a written table with one row a distinct line."""
    keyed = lines.select("id", F.posexplode("gaps").alias("gap", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    some = keyed.join(shared, "key", "left_semi").groupBy("id").agg(F.collect_set("gap").alias("open"))
    wanted = (lines.join(some, "id").select("id", "at", "n", "open").groupBy("at.k1", "at.k2")
              .agg(F.collect_list(F.struct("id", "at", "n", "open")).alias("__wanted")))  # lines of one document
    k1, k2 = hash128("doc_id", F.col(text_col))
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("__text")).join(wanted, ["k1", "k2"])
    texts = texts.withColumn("__text", plain(F.col("__text")))  # after the join: only of texts that have such lines
    found = texts.select(F.explode(F.expr("transform(array(split(__text, '\n')), p -> transform(__wanted, "
                                          "x -> named_struct('x', x, 'line', p[x.at.line_no])))[0]")).alias("f"))
    found = found.select("f.x.*", "f.line").dropDuplicates(["id"]).withColumn("words", F.split(F.trim("line"), " "))
    spans = F.array(*[F.struct(before.alias("lo"), (F.col("n") - after).alias("hi"))
                      for _, before, after in block_spans(F.col("n"))])
    found = materialize(found.withColumn("spans", spans).select(
        "id", F.struct("at.doc_id", "at.k1", "at.line_no").alias("at"), "words",
        F.expr("array_distinct(flatten(transform(open, q -> sequence(spans[q].lo + 1, spans[q].hi))))").alias("places")),
        "line-candidates")
    rows = materialize(variant_rows(found), "line-variants")
    whole = rows.where("place = 0").select("hash", F.lit(0).alias("e_place"), F.col("at").alias("e_at"), F.col("id").alias("e_id"))
    groups = rows.where("place > 0").groupBy("hash", "place").agg(F.min(F.struct("at", "id")).alias("e"), F.count("*").alias("c"))
    groups = groups.select("hash", F.col("place").alias("e_place"), F.col("e.at").alias("e_at"), F.col("e.id").alias("e_id"), "c")
    # deletions look for the earliest that deletes the same place, and for the line that is the variant
    by_gap = (rows.where("place > 0").join(groups.where("c > 1").drop("c").unionByName(whole), "hash")
              .where("(e_place = place or e_place = 0) and e_at < at"))
    # lines look for the earliest of which they are a variant
    longer = groups.groupBy("hash").agg(F.min(F.struct("e_at", "e_id", "e_place")).alias("e")).select("hash", "e.*")
    by_line = rows.where("place = 0").join(longer, "hash").where("e_at < at")
    pairs = by_gap.unionByName(by_line).select("id", "place", "e_id", "e_place")
    words = found.select("id", "words")
    checked = (pairs.join(words, "id").join(words.select(F.col("id").alias("e_id"), F.col("words").alias("e_words")), "e_id")
               .where(without(F.col("words"), F.col("place")) == without(F.col("e_words"), F.col("e_place"))))
    return checked.select("id").distinct()


def line_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """(h1, h2, at, n, gaps) of every line with a word.  A document's key is hashed before its text is cut, once and not once a line."""
    k1, k2 = hash128("doc_id", F.col(text_col))
    texts = docs.where(F.col(text_col).isNotNull()).select("doc_id", k1.alias("k1"), k2.alias("k2"), plain(F.col(text_col)).alias("text"))
    lines = (texts.select("doc_id", "k1", "k2", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
             .withColumn("line", F.trim("line")).where("line <> ''")
             .withColumn("words", F.split("line", " ")).withColumn("n", F.size("words")))
    h1, h2 = hash128("line")
    return with_gap_keys(lines).select(h1.alias("h1"), h2.alias("h2"), F.struct("doc_id", "k1", "line_no", "k2").alias("at"), "n", "gaps")


def dedup_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with duplicate lines removed, ``n_lines`` and ``n_removed`` appended."""
    docs = docs.drop("n_lines", "n_removed")
    k1, k2 = hash128("doc_id", F.col(text_col))
    lines = materialize(line_rows(docs, text_col), "lines")
    distinct = materialize(lines.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("gaps").alias("gaps"))
                           .withColumn("id", F.monotonically_increasing_id()), "distinct-lines")
    near = materialize(near_lines(distinct, docs, text_col), "near-lines")
    # an occurrence goes if its line has an earlier neighbour or stood elsewhere before
    kept_at = distinct.join(near, "id", "left_anti").select("h1", "h2", F.col("at").alias("first"))
    gone = materialize(lines.select("h1", "h2", "at").join(kept_at, ["h1", "h2"], "left")
                       .where(F.col("first").isNull() | (F.col("first") != F.col("at")))
                       .groupBy("at.k1", "at.k2").agg(F.collect_set("at.line_no").alias("__gone")), "gone-lines")
    gone = gone.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "__gone")
    out = docs.withColumns({"__k1": k1, "__k2": k2}).join(gone, ["__k1", "__k2"], "left")
    parts = F.split(text_col, "\n")
    cut = F.transform(F.array(parts), lambda p: F.concat_ws("\n", F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("__gone")), lambda i: p[i])))[0]
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(cut)
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
                      F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))
