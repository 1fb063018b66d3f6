"""Tolerant reader of nested discussions (S2, U4, F11, F12): one narrow pass over the files.

Each line (or, for files that hold one value over several lines, each file) is a record: an object is a
discussion, an array holds discussions, and anything else is kept out but takes a place.  A task parses its
records with an explicit stack, so lists may nest as deep as memory allows, and leaves four kinds of rows: discussions,
comments in depth-first order, skipped records with the reason, and the totals of each split.  The
pass is written once; discussions, comments and counts are read from it.

A discussion without title is called after its place: in its array, or, for objects on lines of their
own, among the records of the file that are no arrays (by the split totals, see ``positions``).
"""

from __future__ import annotations

import json
import re
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from .positions import array_files, offsets, text_rows

#: Rows of the one pass; ``kind`` is post, comment, skipped or split.
PASS = ("kind string, file string, split_start long, whole boolean, line long, place long, entry int, in_array boolean, title string, "
        "pos int, comment_id string, text string, author string, score long, reason string, n_unexpected long")
ROWS_PER_BATCH = 2000

_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|(")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity))')
_WORDS = {"true": True, "false": False, "null": None}


def parse_deep(text: str):
    """The JSON value of a text, without recursion; ValueError for anything else."""
    stack: list = []          # (container, key to set)
    value, at, expect_value = None, 0, True
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError("malformed")
        at, mark = m.end(), m.group(1)
        if not expect_value:
            if not stack or mark not in (",", "]" if isinstance(stack[-1][0], list) else "}"):
                raise ValueError("malformed")
            container, _ = stack[-1]
            if mark == ",":
                key = None
                if isinstance(container, dict):
                    key, at = _key(text, at)
                stack[-1] = (container, key)
                expect_value = True
                continue
            value = stack.pop()[0]
        elif mark in ("[", "{"):
            closing = _TOKEN.match(text, at)
            new: list | dict = [] if mark == "[" else {}
            if closing is not None and closing.group(1) == ("]" if mark == "[" else "}"):
                value, at = new, closing.end()
            else:
                key = None
                if mark == "{":
                    key, at = _key(text, at)
                stack.append((new, key))
                continue
        elif m.group(2):
            value, at = json.decoder.scanstring(text, at, False)
        elif m.group(3):
            value = _WORDS[m.group(3)] if m.group(3) in _WORDS else json.loads(m.group(3))
        else:
            raise ValueError("malformed")
        if not stack:
            if text[at:].strip(" \t\n\r"):
                raise ValueError("malformed")
            return value
        container, key = stack[-1]
        if isinstance(container, list):
            container.append(value)
        else:
            container[key] = value
        expect_value = False


def _key(text: str, at: int) -> tuple[str, int]:
    m = _TOKEN.match(text, at)
    if m is None or not m.group(2):
        raise ValueError("malformed")
    key, at = json.decoder.scanstring(text, m.end(), False)
    m = _TOKEN.match(text, at)
    if m is None or m.group(1) != ":":
        raise ValueError("malformed")
    return key, m.end()


def parse(text: str):
    try:
        return json.loads(text, strict=False)
    except RecursionError:
        return parse_deep(text)


def is_json(text: str) -> bool:
    try:
        parse(text)
    except ValueError:
        return False
    return True


def flatten(comments) -> tuple[list[dict], int]:
    """U4 + F12: the objects of nested lists in depth-first order, and how many items were neither."""
    found, unexpected = [], 0
    stack = [iter(comments)] if isinstance(comments, list) else []
    while stack:
        item = next(stack[-1], stack)
        if item is stack:
            stack.pop()
        elif isinstance(item, list):
            stack.append(iter(item))
        elif isinstance(item, dict):
            found.append(item)
        else:
            unexpected += 1
    return found, unexpected


def as_text(v) -> str | None:
    return v if isinstance(v, str) or v is None else None if isinstance(v, (list, dict)) else json.dumps(v)


def as_long(v) -> int | None:
    try:
        n = int(v)
    except (TypeError, ValueError, OverflowError):
        return None
    return n if -(1 << 63) <= n < 1 << 63 else None


def _rows_of(value: str, base: dict, object_place: int):
    """Rows of one record; yields nothing else if it can't be parsed but a row that says so."""
    try:
        record = parse(value)
    except (ValueError, MemoryError) as e:
        yield base | {"kind": "skipped", "text": value, "reason": "malformed" if isinstance(e, ValueError) else "too large"}
        return
    if not isinstance(record, (list, dict)):
        yield base | {"kind": "skipped", "text": value, "reason": "no object"}
        return
    in_array = isinstance(record, list)
    for i, item in enumerate(record if in_array else [record]):
        if not isinstance(item, dict):
            yield base | {"kind": "skipped", "entry": i, "text": json.dumps(item) if not isinstance(item, list) else "[...]", "reason": "no object"}
            continue
        comments, unexpected = flatten(item.get("comments"))
        post = base | {"entry": i, "in_array": in_array, "place": i if in_array else object_place}
        yield post | {"kind": "post", "title": as_text(item.get("title")), "n_unexpected": unexpected}
        for pos, c in enumerate(comments):
            yield post | {"kind": "comment", "pos": pos, "comment_id": as_text(c.get("comment_id")), "text": as_text(c.get("text")),
                          "author": as_text(c.get("author")), "score": as_long(c.get("score"))}


def _one_pass(whole: bool):
    def run(batches):
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in PASS.split(", "))])
        split, lines, objects, out = None, 0, 0, []

        def total():
            return {"kind": "split", "file": split[0], "split_start": split[1], "whole": whole, "line": lines, "place": objects}

        for batch in batches:
            for file, start, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != split:
                    if split:
                        out.append(total())
                    split, lines, objects = (file, start), 0, 0
                # a file that looked like one value over several lines, but is none, is read as lines
                for record in [value] if not whole or is_json(value) else value.splitlines():
                    if record.strip():
                        base = {"file": file, "split_start": start, "whole": whole, "line": lines}
                        for row in _rows_of(record, base, objects):
                            out.append(row)
                            if len(out) >= ROWS_PER_BATCH:
                                yield pa.RecordBatch.from_pylist(out, schema=schema)
                                out = []
                        objects += not record.lstrip().startswith("[")
                    lines += 1
        if split:
            yield pa.RecordBatch.from_pylist([*out, total()], schema=schema)

    return run


def read(spark: SparkSession, path, whole_file: bool | None = None) -> SimpleNamespace:
    """posts (post_id, title), comments (post_id, comment_id, text, author, score, pos), skipped (file, line_no, entry,
    record, reason) and counts (read, skipped, unexpected: one row) of all files of a path.

    ``whole_file``: whether each file is one record; by default this is seen from the files one by one."""
    if whole_file is None:
        arrays = array_files(spark, path)
        is_array = F.col("file").isin(arrays) if arrays else F.lit(False)
        found = text_rows(spark, path).where(~is_array).mapInArrow(_one_pass(False), PASS)
        if arrays:
            found = found.unionByName(text_rows(spark, path, True).where(is_array).mapInArrow(_one_pass(True), PASS))
    else:
        found = text_rows(spark, path, whole_file).mapInArrow(_one_pass(whole_file), PASS)
    found = found.checkpoint()
    splits = found.where("kind = 'split'").select("file", "split_start", F.col("line").alias("lines"), F.col("place").alias("objects"))
    rows = (found.where("kind <> 'split'").join(offsets(splits, ["lines", "objects"]), ["file", "split_start"])
            .withColumn("line_no", F.col("line") + F.col("lines_before"))
            .withColumn("post_id", F.concat_ws("#", "file", F.col("line_no").cast("string"), F.col("entry").cast("string"))))
    number = F.col("place") + 1 + F.when(F.col("in_array"), 0).otherwise(F.col("objects_before"))
    posts = rows.where("kind = 'post'").select("post_id", F.coalesce(
        "title", F.concat(F.lit(rules.DISCUSSION_TITLE_PREFIX), number.cast("string"))).alias("title"))
    comments = rows.where("kind = 'comment'").select("post_id", "comment_id", "text", "author", "score", "pos")
    skipped = rows.where("kind = 'skipped'").select("file", "line_no", "entry", F.col("text").alias("record"), "reason")
    counts = found.agg(F.count_if(F.col("kind") == "post").alias("read"), F.count_if(F.col("kind") == "skipped").alias("skipped"),
                       F.coalesce(F.sum("n_unexpected"), F.lit(0)).alias("unexpected"))
    return SimpleNamespace(posts=posts, comments=comments, skipped=skipped, counts=counts)


def read_discussions(spark: SparkSession, path, whole_file: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """S2 + U4 + F12: (posts, comments); ``read`` gives the skipped records and counts as well."""
    found = read(spark, path, whole_file)
    return found.posts, found.comments
