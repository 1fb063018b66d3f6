"""Nested post files (S1, S6, S7, S12) and their counted skips (F11); the tolerant reader for
arbitrarily nested comment lists (S2, U4, F12) is in ``discussions``."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as SC
from .discussions import read_discussions  # noqa: F401
from .positions import array_files

CORRUPT = "_corrupt_record"


def _read_raw(spark: SparkSession, path: str, multiline: bool | None, schema: T.StructType | None) -> DataFrame:
    """All records of a path with their ``file``; unless ``multiline`` says so, files that are one array are told
    from files of lines one by one, and each kind is read its way."""
    full = T.StructType([*(schema or SC.POST_FILE).fields, T.StructField(CORRUPT, T.StringType())])

    def rows(multi: bool, keep: Column | None) -> DataFrame:
        r = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        df = (r.option("multiLine", True) if multi else r).json(path)
        df = df.select(*full.names, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
        # the place of a record in what a task reads; files are filtered before they are opened
        return (df if keep is None else df.where(keep)).withColumn("_at", F.monotonically_increasing_id())

    if multiline is not None:
        return rows(multiline, None)
    arrays = array_files(spark, path)
    if not arrays:
        return rows(False, None)
    return rows(False, ~F.col("file").isin(arrays)).unionByName(rows(True, F.col("file").isin(arrays)))


def _split_records(raw: DataFrame, schema: T.StructType | None) -> tuple[DataFrame, DataFrame]:
    """(posts, comments) of the raw records that could be parsed and hold anything."""
    fields = (schema or SC.POST_FILE).names
    raw = raw.where(F.col(CORRUPT).isNull())
    raw = raw.where(F.coalesce(*[F.col(c).cast("string") for c in fields if c != "comments"],
                               F.size("comments").cast("string")).isNotNull())
    place = F.concat_ws("#", F.md5("file"), F.hex("_block"), F.hex("_at"))
    raw = raw.withColumn("post_id", F.coalesce("post_id", F.concat(F.lit("noid-"), place))).select(*fields)
    comments = raw.select("post_id", F.posexplode("comments").alias("pos", "c")).select("post_id", "pos", "c.*")
    return raw.drop("comments"), comments


def read_posts(spark: SparkSession, path: str, multiline: bool | None = None,
               schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """Nested posts -> (posts, comments) long tables.

    Reads JSON lines (splittable, one record per line) and files that are one
    JSON array (one task a file; convert large ones to lines once), also side by side in one folder; which of
    them a file is is seen from its first line, unless ``multiline`` says so for all (then no file is looked at
    beforehand).  Malformed records are skipped (F11; ``read_posts_counted`` counts and lists them); a post without an id gets
    one from its file and place, so equal records stay apart (the same as long as files are split alike).
    """
    return _split_records(_read_raw(spark, path, multiline, schema), schema)


def read_posts_counted(spark: SparkSession, path: str, multiline: bool | None = None,
                       schema: T.StructType | None = None) -> SimpleNamespace:
    """posts, comments, skipped (file, record), and the numbers n_read and n_skipped, all from one scan.

    The records are written once to the checkpoint folder; the numbers are metrics observed on the way."""
    seen = Observation("read_posts")
    raw = _read_raw(spark, path, multiline, schema)
    raw = raw.observe(seen, F.count_if(F.col(CORRUPT).isNull()).alias("n_read"),
                      F.count_if(F.col(CORRUPT).isNotNull()).alias("n_skipped")).checkpoint()
    posts, comments = _split_records(raw, schema)
    skipped = raw.where(F.col(CORRUPT).isNotNull()).select("file", F.col(CORRUPT).alias("record"))
    return SimpleNamespace(posts=posts, comments=comments, skipped=skipped, **seen.get)


def skipped_records(spark: SparkSession, path: str, multiline: bool | None = None,
                    schema: T.StructType | None = None) -> DataFrame:
    """the records that ``read_posts`` skips, as (file, record)."""
    return read_posts_counted(spark, path, multiline, schema).skipped


def write_posts_json(posts: DataFrame, comments: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Re-nest comments under their post and write JSON lines.

    Nulls are written (``ignoreNullFields=false``); non-ASCII is kept.  A
    post's comment list is one value by definition, so it is built per post
    after a shuffle on post_id.  Never overwrite a path being read: S12
    writes to a new directory.
    """
    ccols = [c for c in comments.columns if c not in ("post_id", "pos")]
    nested = (comments.groupBy("post_id")
              .agg(F.sort_array(F.collect_list(F.struct("pos", *ccols))).alias("_c"))
              .select("post_id", F.transform("_c", lambda s: s.dropFields("pos")).alias("comments")))
    out = posts.join(nested, "post_id", "left").withColumn(
        "comments", F.coalesce("comments", F.array().cast(nested.schema["comments"].dataType)))
    out.write.mode(mode).option("ignoreNullFields", False).json(path)


def flatten_posts(posts: DataFrame) -> DataFrame:
    """Drop the comments and every struct/array field, then add joined
    platforms / games / keywords and the two sentiment scalars."""
    keep = []
    for f in posts.schema.fields:
        if f.name == "comments" or isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            continue
        if f.name == "created_ts":
            keep.append(F.date_format("created_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
        else:
            keep.append(F.col(f.name))
    return posts.select(
        *keep,
        F.array_join("platform", ",").alias("platforms"),
        F.array_join("potential_games", ",").alias("potential_games"),
        F.array_join("bug_keywords_found", ",").alias("bug_keywords"),
        F.col("sentiment.polarity").alias("sentiment_polarity"),
        F.col("sentiment.subjectivity").alias("sentiment_subjectivity"))


def save_posts(posts: DataFrame, comments: DataFrame, path: str, output_format: str = "json",
               mode: str = "errorifexists") -> None:
    """S6/S7 dispatcher: 'json' (nested) or 'csv' (flat).  Any other format
    raises instead of silently doing nothing."""
    fmt = output_format.lower()
    if fmt == "json":
        write_posts_json(posts, comments, path, mode)
    elif fmt == "csv":
        write_csv(flatten_posts(posts), path, mode=mode)
    else:
        raise ValueError(f"unknown output format {output_format!r}; use 'json' or 'csv'")


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Header, quotes doubled inside quoted fields."""
    (df.write.mode(mode).option("header", True).option("sep", sep)
     .option("escape", '"').option("quoteAll", False).csv(path))
