"""Keyword rules (X1-X7): lower-case substring matching by default.

Every rule is an OR-chain of ``contains`` on literals, so it stays inside
whole-stage codegen (no Python, no higher-order-function fallback).
``word_boundary=True`` switches to whole-word regex matching.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from ._util import col


def lower_text(c, lowered: bool = False) -> Column:
    """Lower-case, null read as empty text.  ``lowered=True`` means the
    caller already lower-cased the column once for several rules."""
    if lowered:
        return F.coalesce(col(c), F.lit(""))
    return F.lower(F.coalesce(col(c), F.lit("")))


def _hit(x: Column, kw: str, word_boundary: bool) -> Column:
    if word_boundary:
        return x.rlike(f"(?<![\\p{{L}}\\p{{N}}])\\Q{kw}\\E(?![\\p{{L}}\\p{{N}}])")
    return x.contains(kw)


def contains_any(x: Column, keywords, word_boundary: bool = False) -> Column:
    """True when the (already lower-cased) text holds any keyword."""
    kws = list(dict.fromkeys(keywords))
    if not kws:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [_hit(x, k, word_boundary) for k in kws])


def detect_platform(text, platform_keywords=None, word_boundary=False, lowered=False) -> Column:
    """Every platform with a hit, dictionary order; none -> ['unspecified']."""
    pk = rules.PLATFORM_KEYWORDS if platform_keywords is None else platform_keywords
    x = lower_text(text, lowered)
    hits = [F.when(contains_any(x, kws, word_boundary), F.lit(p)).otherwise(F.lit("")) for p, kws in pk.items()]
    found = F.array_remove(F.array(*(hits or [F.lit("")])), "")
    return F.when(F.size(found) == 0, F.array(F.lit(rules.UNSPECIFIED))).otherwise(found)


def detect_severity(text, severity_keywords=None, word_boundary=False, lowered=False) -> Column:
    """First severity level with a hit, else 'unspecified'."""
    sk = rules.SEVERITY_KEYWORDS if severity_keywords is None else severity_keywords
    x = lower_text(text, lowered)
    out = None
    for level, kws in sk.items():
        cond = contains_any(x, kws, word_boundary)
        out = F.when(cond, F.lit(level)) if out is None else out.when(cond, F.lit(level))
    return F.lit(rules.UNSPECIFIED) if out is None else out.otherwise(F.lit(rules.UNSPECIFIED))


def label_post(text, bug_keywords=None, feature_keywords=None,
               question_keywords=None, word_boundary=False, lowered=False) -> Column:
    """Bug -> Feature Request -> Question -> Other; empty -> Uncategorized."""
    t = col(text)
    x = lower_text(t, lowered)
    return (F.when(t.isNull() | (t == ""), F.lit(rules.CATEGORY_EMPTY))
            .when(contains_any(x, rules.BUG_KEYWORDS if bug_keywords is None else bug_keywords, word_boundary),
                  F.lit(rules.CATEGORY_BUG))
            .when(contains_any(x, rules.FEATURE_KEYWORDS if feature_keywords is None else feature_keywords, word_boundary),
                  F.lit(rules.CATEGORY_FEATURE))
            .when(contains_any(x, rules.QUESTION_KEYWORDS if question_keywords is None else question_keywords, word_boundary),
                  F.lit(rules.CATEGORY_QUESTION))
            .otherwise(F.lit(rules.CATEGORY_OTHER)))


def keywords_found(text, keywords=None, word_boundary=False, lowered=False) -> Column:
    """Keywords present, in list order, duplicates in the list kept."""
    kws = rules.BUG_KEYWORDS if keywords is None else keywords
    x = lower_text(text, lowered)
    hits = [F.when(_hit(x, k, word_boundary), F.lit(k)).otherwise(F.lit("")) for k in kws]
    return F.array_remove(F.array(*(hits or [F.lit("")])), "")


def has_any(text, keywords, word_boundary=False, lowered=False) -> Column:
    """Any keyword present (null text -> false)."""
    return contains_any(lower_text(text, lowered), keywords, word_boundary)
