"""Merkle manifest of a dataset: one tree a source, one tree over the sources, and a
proof for each row that a recursive query climbs.

1. Leaves are numbered in the order of (source, id): they are written in order once, and the row
   counts of the written partitions (one row a partition) become offsets.
2. Levels are built FOLD at a time: 3^FOLD consecutive nodes of a tree meet in one group and leave
   it as one node.  Every run of up to three siblings is stored as a row: its children's
   digests, and a link to the run that holds its own digest, with the place there.
3. A recursive query climbs from every leaf to the root.  A step joins a leaf with the run it has
   reached, appends the digests of the siblings as a row of the leaf's proof, and folds them with what it
   carries: the digest of the tampered leaf at first.
4. Near the root all leaves of a source want the same run.  A run is therefore stored once for each
   block of BLOCK leaves below it and joined by (run, block), so no key has more than
   BLOCK leaves.

Digests are lowercase hex sha256 and are hashed as hex text; tables keep them as 32 bytes.

Defined results: null values are written as ``-`` (a null source is a source of its own and the first, a null id
comes first in its source and is never tampered with); an empty text is ``0:``; texts of any length are
hashed whole; rows with equal ids are ordered by their leaf, and equal rows are leaves next to each other, each with its own proof;
a single row is its own root and has an empty proof; an empty table has no rows and no root.  Extra columns are
returned unchanged (the text is not carried along); those that clash with the columns added here are replaced.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import BATCH_ROWS, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Levels that one shuffle builds.
FOLD = 5
#: Leaves that may wait for one stored run.
BLOCK = 4096
#: Run ids are (level, number of the first leaf below); levels of the tree over the sources start here.
LEVEL_BITS, TOP = 56, 64
ADDED = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

RUN_SCHEMA = ("up boolean, base long, size long, parent long, slot int, pos long, lo long, hi long, digest string, "
              "run long, kids binary, sub binary, root binary")


def leaf_digest(text: Column, fields=FIELDS) -> Column:
    """Digest of one row, with ``text`` for its text."""
    parts = []
    for c in fields:
        v = (text if c == "text" else F.col(c)).cast("string")
        parts.append(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
    return F.sha2(F.concat(*parts), 256)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``no``: the place of each row in this order, from 0; equal rows get places of their own."""
    rows = materialize(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row a written partition
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))
    return (rows.withColumn("__part", part).join(offsets, "__part")
            .withColumn("no", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__before"))


def run_id(level: int, first: int) -> int:
    return level << LEVEL_BITS | first


def levels_up(level0: int, level: int):
    """Arrow function: groups of nodes of one level -> their runs (FOLD levels) and the node each group leaves."""

    def runs(row: dict):
        base, size, kids = row["base"], row["size"], row["kids"]
        at = level
        for _ in range(FOLD):
            if size == 1:
                break
            size = -(-size // ARITY)
            above = []
            for i in range(0, len(kids), ARITY):
                run = kids[i:i + ARITY]
                digest = hashlib.sha256("".join(k["digest"] for k in run).encode()).hexdigest()
                node = {"pos": run[0]["pos"] // ARITY, "lo": run[0]["lo"], "hi": run[-1]["hi"], "digest": digest}
                above.append(node)
                own = bytes.fromhex(digest)
                out = {"run": run_id(level0 + at, base + node["pos"] * ARITY ** (at + 1)), "lo": node["lo"], "hi": node["hi"],
                       "kids": b"".join(bytes.fromhex(k["digest"]) for k in run)}
                if size > 1:
                    out |= {"parent": run_id(level0 + at + 1, base + node["pos"] // ARITY * ARITY ** (at + 2)),
                            "slot": node["pos"] % ARITY}
                else:
                    out |= {"parent": row["parent"], "slot": row["slot"], "sub": own if level0 == 0 else None,
                            "root": own if row["parent"] is None else None}
                yield out
            kids, at = above, at + 1
        yield {"up": True, "size": size, **{c: row[c] for c in ("base", "parent", "slot")}, **kids[0]}

    def run(batches):
        names = [f.split()[0] for f in RUN_SCHEMA.split(", ")]
        kinds = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, RUN_SCHEMA.split(", "))])
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                out.extend(runs(batch.slice(row, 1).to_pylist()[0]))
                if len(out) >= BATCH_ROWS or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []

    return run


def build_levels(nodes: DataFrame, level0: int, height: int, name: str) -> tuple[DataFrame | None, DataFrame]:
    """(runs, tops) of all trees whose level-0 nodes are given as (base, size, parent, slot, pos, lo, hi, digest)."""
    found, level = None, 0
    while level < height:
        groups = (nodes.groupBy("base", "size", "parent", "slot", F.floor(F.col("pos") / ARITY ** FOLD).alias("group"))
                  .agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi", "digest"))).alias("kids")))
        built = materialize(groups.mapInArrow(levels_up(level0, level), RUN_SCHEMA), name)
        runs = built.where("up is null").select("run", "lo", "hi", "kids", "parent", "slot", "sub", "root")
        found = runs if found is None else found.unionByName(runs)
        nodes = built.where("up").select("base", "size", "parent", "slot", "pos", "lo", "hi", "digest")
        level += FOLD
    return found, nodes


def height_of(size: int) -> int:
    h = 0
    while size > 1:
        size, h = -(-size // ARITY), h + 1
    return h


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> tuple[DataFrame, DataFrame | None]:
    """(leaves, runs) of rows that have FIELDS and, for the digests that proofs start from, ``start``.

    leaves: the rows with ``no``, ``leaf`` (32 bytes), and the ``run`` and ``slot`` where they stand (null: the row is the root).
    runs: the stored levels, one row a run and block of leaves (run, block, kids, parent, slot, sub, root);
    None if there is only one leaf."""
    order = [F.col(source_col).asc_nulls_first(), F.col(id_col).asc_nulls_first(), F.col("leaf")]
    leaves = materialize(numbered(docs, order, "merkle-ordered"), "merkle-leaves")
    sources = leaves.groupBy(F.col(source_col).alias("__source")).agg(F.min("no").alias("base"), F.count("*").alias("size"))
    sources = materialize(numbered(sources, [F.col("base")], "merkle-sources").withColumnRenamed("no", "ordinal"), "merkle-sources")
    n_sources, most = sources.agg(F.count("*"), F.max("size")).first()
    if not n_sources:
        return leaves.withColumns({"run": F.lit(None).cast("long"), "slot": F.lit(None).cast("int")}), None
    up = F.lit(TOP << LEVEL_BITS) + F.col("ordinal") - F.col("ordinal") % ARITY
    sources = sources.withColumns({"parent": F.when(F.lit(n_sources > 1), up),
                                   "slot": F.when(F.lit(n_sources > 1), (F.col("ordinal") % ARITY).cast("int"))})
    # the rows of a source in a written partition are one span; joined by both, a hot source is many keys
    spans = (leaves.groupBy("__part", F.col(source_col).alias("__source")).agg(F.count("*").alias("__n")).drop("__n").alias("s")
             .join(sources.drop("__part").alias("t"), F.expr("s.__source <=> t.__source"))
             .select(F.col("__part").alias("__p"), "s.__source", "base", "size", "parent", "slot"))
    placed = leaves.join(spans, (F.col("__part") == F.col("__p")) & F.col(source_col).eqNullSafe(F.col("__source")))
    placed = placed.drop("__p", "__part", "__source").withColumn("pos", F.col("no") - F.col("base"))
    nodes = placed.select("base", "size", "parent", "slot", "pos", F.col("no").alias("lo"), F.col("no").alias("hi"),
                          F.lower(F.hex("leaf")).alias("digest"))
    runs, tops = build_levels(nodes, 0, height_of(most), "merkle-runs")
    if n_sources > 1:
        top = tops.join(sources.select("base", "ordinal"), "base").select(
            F.lit(0).cast("long").alias("base"), F.lit(n_sources).cast("long").alias("size"), F.lit(None).cast("long").alias("parent"),
            F.lit(None).cast("int").alias("slot"), F.col("ordinal").alias("pos"), "lo", "hi", "digest")
        above, _ = build_levels(top, TOP, height_of(n_sources), "merkle-top")
        runs = above if runs is None else runs.unionByName(above)
    first = F.col("base") + F.col("pos") - F.col("pos") % ARITY
    alone = F.col("size") == 1
    leaves = placed.withColumns({"run": F.when(alone, F.col("parent")).otherwise(first),
                                 "slot": F.when(alone, F.col("slot")).otherwise((F.col("pos") % ARITY).cast("int"))})
    leaves = leaves.drop("base", "size", "parent", "pos")
    if runs is not None:
        blocks = F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))
        runs = materialize(runs.withColumn("block", F.explode(blocks)).drop("lo", "hi"), "merkle-nodes")
    return leaves, runs


CLIMB = """
WITH RECURSIVE climb(no, step, run, slot, fold, sib, sub, root) AS (
  SELECT no, 0, run, slot, start, CAST(NULL AS BINARY), CAST(NULL AS BINARY), CAST(NULL AS BINARY) FROM {leaves}
  UNION ALL
  SELECT no, step + 1, parent, next_slot, unhex(sha2(lower(hex(concat(before, fold, after))), 256)), concat(before, after), sub, root
  FROM (SELECT c.no, c.step, c.fold, r.parent, r.slot AS next_slot, r.sub, r.root,
               substring(r.kids, 1, 32 * c.slot) AS before, substring(r.kids, 32 * c.slot + 33, 64) AS after
        FROM climb c JOIN {runs} r ON c.run = r.run AND c.no div {block} = r.block))
SELECT no, step, sib, CASE WHEN run IS NULL THEN fold END AS folded, sub, root FROM climb
"""


def climb(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """(no, proof, folded, sub, root) of every leaf: what a recursive query gathers on its way from ``start`` to the root."""
    spark = leaves.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the climb has as many rows as leaves times levels
    names = {k: f"merkle_{k}_{uuid.uuid4().hex[:12]}" for k in ("leaves", "runs")}
    leaves.createOrReplaceTempView(names["leaves"])
    runs.createOrReplaceTempView(names["runs"])
    steps = spark.sql(CLIMB.format(block=BLOCK, **names))
    for view in names.values():
        spark.catalog.dropTempView(view)
    siblings = F.sort_array(F.collect_list(F.when(F.col("sib").isNotNull(), F.struct("step", "sib"))))
    return steps.groupBy("no").agg(F.array_join(F.transform(siblings, lambda s: F.lower(F.hex(s["sib"]))), "").alias("proof"),
                                   *[F.max(c).alias(c) for c in ("folded", "sub", "root")])


def prove(docs: DataFrame, tampered_text: Column | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Append leaf, subroot, root, proof_sha256, and folded_root and verified: the root that the proof
    gives for the row with ``tampered_text`` (default: its own text), and whether it is the root."""
    docs = docs.drop(*ADDED, "start", "no", "run", "slot")
    leaf = leaf_digest(F.col("text"))
    start = leaf if tampered_text is None else F.when(tampered_text.eqNullSafe(F.col("text")), leaf).otherwise(leaf_digest(tampered_text))
    kept = [c for c in docs.columns if c != "text"]
    rows = docs.select(*kept, F.unhex(leaf).alias("leaf"), F.unhex(start).alias("start"))
    leaves, runs = manifest(materialize(rows, "merkle-digests"), id_col, source_col)  # texts are hashed once

    def text(c: str) -> Column:
        return F.lower(F.hex(c))

    if runs is None:
        out = leaves.withColumns({"proof": F.lit(""), "folded": F.col("start"), "sub": F.col("leaf"), "root": F.col("leaf")})
    else:
        paths = climb(leaves.select("no", "run", "slot", "start"), runs)
        out = leaves.join(paths, "no").withColumn("sub", F.coalesce("sub", "leaf")).withColumn("root", F.coalesce("root", "sub"))
    return out.select(*kept, text("leaf").alias("leaf"), text("sub").alias("subroot"), text("root").alias("root"),
                      F.sha2("proof", 256).alias("proof_sha256"), text("folded").alias("folded_root"),
                      (F.col("folded") == F.col("root")).alias("verified"))


def without_line_breaks(id_col: str = "doc_id") -> Column:
    """The contract's tampering: texts of rows whose id has an even crc32 lose their line breaks."""
    even = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 2 == 0, F.lit(False))
    return F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
