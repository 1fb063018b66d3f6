"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct word shingles as 64-bit hashes.  Its sketch
has ``SIZE`` coordinates: in round i every shingle falls into a hashed bin with a
hashed value, and bins that are still empty keep the least; from round SIZE on,
round i fills bin i - SIZE with certainty.  So every coordinate fills, mostly in
the first rounds, and agreement of coordinates concentrates around the Jaccard
similarity as with independent hashes.

Equal sets are one class from the start.  Classes that share a band of ROWS
coordinates are candidates; small buckets yield all their pairs, buckets of more
than SMALL classes a star around a pivot that differs by band.  All candidates are verified
on the full shingle sets, and links contracted to components.  Then the members of
large buckets are bucketed again by pairs of large bands (up to REACH apart): what merely
shares a passage falls apart, small buckets yield all their pairs between
components, large ones stars around PIVOTS further pivots.  These stars only save
work: the members of large buckets that still span components go through an exact
join of shingles, with pairs of one component left out.  Shingles are ordered, those of
one component alone first, then by how many sets hold them; two sets that are near
have their first common shingle so early that what follows suffices for the
threshold, and only such places are joined.  So what a big family shares by its template
makes no candidates.

A pair at the threshold 0.8 shares no band with probability (1 - 0.8^6)^40 < 6e-6;
a pair that shares one is linked or lies in one component.

Defined results: null, empty and blank texts have an empty set and stand alone;
texts with fewer words than a shingle have their whole sequence as one; rows with
equal ids are each returned; a null id is never a component's least id unless
the group has no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import hash128, materialize
from .graph import components

ROWS, BANDS = 6, 40
SIZE = ROWS * BANDS
SMALL = 24
#: Further pivots of a large pair of bands, and how far apart the bands of a pair are at most (they save work for the exact join).
PIVOTS, REACH = 2, 4
#: Bits of a coordinate that hold the round; the rest is the hashed value.
ROUND_BITS = 10

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


ROUND_KEYS = constants(2 * SIZE, 101)
ROW_KEYS, BAND_KEYS = constants(ROWS, 202), constants(BANDS, 303)


def digests(words) -> np.ndarray:
    """64 bits of each word (quicker than remembering them)."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, A-Z lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = digests(words)
    k = min(k, len(words))
    keys = constants(k, 404 + k)
    total = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        total += mixed(h[i:len(h) - k + 1 + i]) * keys[i]
    return np.unique(mixed(total))


def sketch(items: np.ndarray) -> np.ndarray:
    """SIZE coordinates (round, value) of a non-empty set."""
    out = np.full(SIZE, np.iinfo(np.uint64).max, dtype=np.uint64)
    first, block = 0, max(1, 2048 // len(items))
    while first < 2 * SIZE:
        rounds = np.arange(first, min(first + block, 2 * SIZE), dtype=np.uint64)
        x = mixed(items[None, :] ^ ROUND_KEYS[rounds.astype(np.int64)][:, None])
        bins = ((x >> U(32)) * U(SIZE)) >> U(32)
        bins = np.where(rounds[:, None] < U(SIZE), bins, rounds[:, None] - U(SIZE))
        value = (rounds[:, None] << U(64 - ROUND_BITS)) | (mixed(x) >> U(ROUND_BITS))
        np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        if (out != np.iinfo(np.uint64).max).all():
            break
        first += block
    return out


def band_keys(items: np.ndarray) -> np.ndarray:
    rows = sketch(items).reshape(BANDS, ROWS)
    return mixed((mixed(rows) * ROW_KEYS).sum(axis=1, dtype=np.uint64) ^ BAND_KEYS).view(np.int64)


def set_key(items: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    a = mixed(items ^ U(0x5851F42D4C957F2D))
    return (int(a.sum(dtype=np.uint64)).to_bytes(8, "little")
            + int(np.bitwise_xor.reduce(mixed(a + U(77)))).to_bytes(8, "little"))


SIGNED = T.StructType([T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()),
                       T.StructField("bands", T.ArrayType(T.LongType(), False))])


def signed(df: DataFrame, k: int) -> DataFrame:
    """Replace ``__text`` (the last column) by the set's size, key and band keys (null for empty sets)."""
    schema = T.StructType([*df.schema.fields[:-1], *SIGNED.fields])
    width = len(df.columns) - 1

    def run(batches):
        for batch in batches:
            n, nodes, bands = [], [], []
            for text in batch.column(width):
                items = shingle_set(text.as_py(), k)
                n.append(len(items))
                nodes.append(set_key(items) if len(items) else None)
                bands.append(band_keys(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(n, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(bands, pa.list_(pa.field("element", pa.int64(), False)))], names=schema.names)

    return df.mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 |A & B| >= percent |A | B|."""
    t = texts.select("node", "text")
    rows = (pairs.select("a", "b").join(t.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .join(t.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))

    def run(batches):
        last, left = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(i) for i in (0, 2, 3))):
                if a.as_py() != last:
                    last, left = a.as_py(), shingle_set(x.as_py(), k)
                right = shingle_set(y.as_py(), k)
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def crossing_pairs(nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of nodes of different components, among them all pairs that are near.

    ``nodes``: (node, component); ``texts``: a written table (node, text)."""
    def shingled(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), k).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.list_(pa.field("element", pa.int64(), False)))],
                                             names=["node", "component", "items"])

    schema = T.StructType([*nodes.select("node", "component").schema.fields, T.StructField("items", T.ArrayType(T.LongType(), False))])
    sets = materialize(nodes.join(texts, "node").select("node", "component", "text").mapInArrow(shingled, schema), "sets")
    items = sets.select("node", "component", F.size("items").alias("n"), F.explode("items").alias("item"))
    crossing = (items.groupBy("item").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"))
                .where("lo != hi").select("item", "c"))
    # shingles in order, those inside one component first (left out, as no pair of interest shares them)
    ordered = (items.join(crossing, "item").groupBy("node", "component", "n")
               .agg(F.sort_array(F.collect_list(F.struct("c", "item"))).alias("s")).withColumn("inside", F.expr("n - size(s)")))
    keyed = materialize(ordered.select("node", "component", "n", "inside", F.posexplode("s").alias("i", "s"))
                        .select("node", "component", "n", (F.col("n") - F.col("inside") - F.col("i")).alias("left"), "s.item")
                        .where(F.col("left") * 100 >= F.col("n") * percent), "first-shingles")
    # of the commonest component of a shingle, pairs with the others only
    most = (keyed.groupBy("item", "component").agg(F.count("*").alias("c"))
            .groupBy("item").agg(F.max_by("component", F.struct("c", "component")).alias("most"), F.count("*").alias("parts"))
            .where("parts > 1").drop("parts"))
    keyed = materialize(keyed.join(most, "item").withColumn("minor", F.col("component") != F.col("most")).drop("most"), "first-shingles")
    short = keyed.where(F.col("left") * (100 + percent) >= F.col("n") * (2 * percent)).alias("x")  # no near set is larger and has it later
    x_minor, y_minor = short.where("minor"), keyed.where("minor").alias("y")
    near = [F.col("x.item") == F.col("y.item"), F.col("x.component") != F.col("y.component"),
            F.struct("x.n", "x.node") < F.struct("y.n", "y.node"), F.col("x.n") * 100 >= F.col("y.n") * percent,
            F.least("x.left", "y.left") * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent]
    pairs = x_minor.join(keyed.alias("y"), near).select("x.node", F.col("y.node").alias("other")).union(
        short.where("not minor").join(y_minor, near).select("x.node", F.col("y.node").alias("other")))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) with the components joined that the links (a, b) join; their labels are the nodes of a smaller graph."""
    merged = materialize(components(found.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
                                    .join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
                                    .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "labels")
    new = merged.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    old = labels.join(new, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    return materialize(old.union(merged.join(labels, "node", "left_anti")), "labels")


def similar_classes(classes: DataFrame, texts_of, k: int, percent: int) -> DataFrame:
    """(node, component) of the classes that have a link to another.

    ``classes``: a written table (node, bands); ``texts_of(nodes)`` gives a written
    table (node, text) of the nodes asked for."""
    keyed = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high"),
                                                   F.min_by("node", F.xxhash64("node", "key")).alias("pivot"))
                          .where("size > 1"), "buckets")
    members = materialize(keyed.join(buckets.where("size > 2").select("key", "size", "pivot"), "key"), "members")
    twos = buckets.where("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    few = (members.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("m"))
           .select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as a, y as b))))"))
                   .alias("p")).select("p.*"))
    star = (members.where((F.col("size") > SMALL) & (F.col("node") != F.col("pivot")))
            .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")))
    pairs = materialize(twos.union(few).union(star).groupBy("a", "b").agg(F.count("*").alias("shared")), "pairs")

    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    texts = texts_of(asked.distinct())

    links = materialize(verified(pairs, texts, k, percent), "links")
    labels = materialize(components(links), "labels")

    # large buckets that span components: by pairs of their bands, which tell apart what shares little
    near = f"try_element_at(m, pmod(e.key + d, {BANDS}))"
    large = (members.where(F.col("size") > SMALL).groupBy("node")
             .agg(F.map_from_entries(F.collect_list(F.struct("band", "key"))).alias("m"))  # <= BANDS keys
             .select("node", F.explode(F.expr(
                 f"filter(flatten(transform(map_entries(m), e -> transform(sequence(1, {REACH}), "
                 f"d -> if({near} is null, null, xxhash64(e.value, {near}))))), x -> x is not null)")).alias("key"))
             .join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    large = materialize(large, "large")
    spans = large.groupBy("key").agg(
        F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"),
        *[F.min_by(F.struct("node", "component"), F.xxhash64("node", "key", F.lit(i))).alias(f"pivot{i}")
          for i in range(PIVOTS)]).where("lo != hi")
    inside = materialize(large.join(spans, "key"), "spans")
    few = (inside.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "component"))).alias("m"))
           .select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), "
                                    "y -> y.component != x.component), y -> struct(x.node as a, y.node as b))))")).alias("p"))
           .select("p.*"))
    star = (inside.where(F.col("size") > SMALL)
            .withColumn("pivot", F.explode(F.filter(F.array(*[f"pivot{i}" for i in range(PIVOTS)]),
                                                    lambda p: p["component"] != F.col("component"))))
            .select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")))
    more = materialize(few.union(star).distinct(), "pairs")
    found = materialize(verified(more, texts, k, percent), "links")
    labels = joined(labels, found)

    # large buckets that still span components: their members exactly
    large = materialize(members.where(F.col("size") > SMALL).select("node", "key").join(labels, "node", "left")
                        .withColumn("component", F.coalesce("component", "node")), "large")
    spans = large.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    rest = materialize(large.join(spans, "key", "left_semi").select("node", "component").distinct(), "rest")
    if rest.limit(1).count():
        pairs = materialize(crossing_pairs(rest, texts, k, percent), "pairs")
        labels = joined(labels, materialize(verified(pairs, texts, k, percent), "links"))
    return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (least id of the group) and kept of every row."""
    t1, t2 = hash128(F.col("__text"))
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = materialize(signed(src.select("__id", t1.alias("t1"), t2.alias("t2"), "__text"), k), "signed")
    classes = materialize(rows.where("node is not null").groupBy("node").agg(
        F.min("__id").alias("least"), F.min(F.struct("t1", "t2")).alias("t"), F.first("bands").alias("bands")), "classes")

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(nodes, "node").select("node", "t.t1", "t.t2")
        return materialize(src.select("__text", t1.alias("t1"), t2.alias("t2")).join(wanted, ["t1", "t2"])
                           .groupBy("node").agg(F.first("__text").alias("text")), "texts")

    labels = similar_classes(classes.select("node", "bands"), texts_of, k, percent)
    with_label = classes.select("node", "least").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    lowest = with_label.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = materialize(with_label.join(lowest, "component").select("node", "component_id"), "of-class")
    out = rows.select("__id", "n", "node").join(of_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("component_id"))
    return out.select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("__id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, all columns unchanged: the one with the
    least id (null ids first), then the least hash of the row.  Rows without words form no
    groups and all stay; rows equal in all columns count once."""
    row = docs.withColumn("__row", F.concat(F.hex(F.xxhash64(*docs.columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(7919), *docs.columns))))
    marked = near_duplicates(row.select(F.struct(id_col, "__row").alias("__id2"), text_col), k, percent, "__id2", text_col)
    kept = marked.where("kept").select(F.col("__id2.__row").alias("__row")).distinct()
    return row.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)
