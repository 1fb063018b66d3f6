"""Text scalars (X8-X14, X21-X23, X26) as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

# Sentence boundary: [.!?] followed by white space (the white space is dropped).
SENTENCE_BOUNDARY = r"(?U)(?<=[.!?])\s+"
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def strip(c, unicode: bool = True) -> Column:
    """Strip leading/trailing white space, any Unicode kind by default (``trim``
    strips only spaces)."""
    pat = r"(?U)^\s+|\s+$" if unicode else r"^\s+|\s+$"
    return F.regexp_replace(col(c), pat, "")


def normalize_title(c) -> Column:
    """Keep [a-zA-Z0-9 ], strip, lower. Inner runs of spaces stay."""
    return F.lower(F.trim(F.regexp_replace(col(c), "[^a-zA-Z0-9 ]", "")))


def mask_handles_urls(c) -> Column:
    """On single-space tokens, '@x...' -> '@user', 'http...' -> 'http'."""
    x = col(c)
    # The regexes only run on texts that can match (a cheap byte search first).
    t = F.when(x.contains("@"), F.regexp_replace(x, r"(?<=^| )@[^ ]+", "@user")).otherwise(x)
    return F.when(t.contains("http"), F.regexp_replace(t, r"(?<=^| )http[^ ]*", "http")).otherwise(t)


def clean_markup(c) -> Column:
    """X11: drop '#', '_' -> space."""
    return F.translate(col(c), "_#", " ")


def epoch_to_iso(c) -> Column:
    """Epoch seconds -> ISO text in the session time zone (pinned to UTC)."""
    return F.date_format(F.timestamp_seconds(col(c)), "yyyy-MM-dd'T'HH:mm:ss")


def full_text(title, text) -> Column:
    """Title + ' ' + text (null parts read as empty, the space always kept)."""
    return F.concat(F.coalesce(col(title), F.lit("")), F.lit(" "),
                    F.coalesce(col(text), F.lit("")))


def head_chars(c, n: int = 512) -> Column:
    """First ``n`` characters (only for callers that want a model cut-off)."""
    return F.substring(col(c), 1, n)


def tokenize(c, clean: bool = True) -> Column:
    """Lower-case runs of letters and digits; '#' dropped and '_' split first (X11)."""
    t = F.coalesce(col(c), F.lit(""))
    if clean:
        t = clean_markup(t)
    return F.array_remove(F.split(F.lower(t), TOKEN_SPLIT), "")


def sentence_pieces(c) -> Column:
    """X21 building block: split at [.!?]+white space, keeping the mark.

    Trailing empty pieces are kept (split limit -1), which the summary
    operator relies on to know whether a text ends a sentence.
    """
    return F.split(col(c), SENTENCE_BOUNDARY, -1)


def bullets(arr) -> Column:
    """X23: '- s' per element, one per line."""
    a = col(arr)
    return F.when(F.size(a) > 0, F.concat(F.lit("- "), F.array_join(a, "\n- "))) \
        .otherwise(F.lit(""))


def underline(c, ch: str = "=") -> Column:
    """A run of ``ch`` as long as the text."""
    return F.expr(f"repeat('{ch}', length({c}))") if isinstance(c, str) else \
        F.repeat(F.lit(ch), F.length(c))
