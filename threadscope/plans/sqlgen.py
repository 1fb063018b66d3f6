"""Small helpers that render the same parameters the Spark side uses as
DuckDB SQL fragments, so oracle and query cannot drift apart."""

from __future__ import annotations

import math

from .. import rules

LN_POS = repr(math.log(rules.BOOST_POSITIVE))
LN_NEG = repr(math.log(rules.BOOST_NEGATIVE))
WS_TRIM = r"regexp_replace({x}, '^[\s\p{{Z}}\x0B\x85]+|[\s\p{{Z}}\x0B\x85]+$', '', 'g')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(items) -> str:
    return ", ".join(q(i) for i in items)


def strip(x: str) -> str:
    return WS_TRIM.format(x=x)


def lower_text(x: str) -> str:
    return f"lower(coalesce({x}, ''))"


def contains_any(x: str, kws) -> str:
    kws = list(dict.fromkeys(kws))
    return "(" + " OR ".join(f"contains({x}, {q(k)})" for k in kws) + ")"


def platform(x: str, pk=None) -> str:
    """X1 as a comma-joined string."""
    pk = pk or rules.PLATFORM_KEYWORDS
    lx = lower_text(x)
    parts = ", ".join(f"CASE WHEN {contains_any(lx, kws)} THEN {q(p)} END" for p, kws in pk.items())
    return f"coalesce(nullif(concat_ws(',', {parts}), ''), {q(rules.UNSPECIFIED)})"


def severity(x: str, sk=None) -> str:
    sk = sk or rules.SEVERITY_KEYWORDS
    lx = lower_text(x)
    whens = " ".join(f"WHEN {contains_any(lx, kws)} THEN {q(lv)}" for lv, kws in sk.items())
    return f"CASE {whens} ELSE {q(rules.UNSPECIFIED)} END"


def label(x: str, bug=None) -> str:
    lx = lower_text(x)
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN {q(rules.CATEGORY_EMPTY)} "
            f"WHEN {contains_any(lx, bug or rules.BUG_KEYWORDS)} THEN {q(rules.CATEGORY_BUG)} "
            f"WHEN {contains_any(lx, rules.FEATURE_KEYWORDS)} THEN {q(rules.CATEGORY_FEATURE)} "
            f"WHEN {contains_any(lx, rules.QUESTION_KEYWORDS)} THEN {q(rules.CATEGORY_QUESTION)} "
            f"ELSE {q(rules.CATEGORY_OTHER)} END")


def keywords_found(x: str, kws=None) -> str:
    """X4 as a comma-joined string (list order, duplicates kept)."""
    kws = kws or rules.BUG_KEYWORDS
    lx = lower_text(x)
    parts = ", ".join(f"CASE WHEN contains({lx}, {q(k)}) THEN {q(k)} END" for k in kws)
    return f"concat_ws(',', {parts})"


def has_any(x: str, kws) -> str:
    return contains_any(lower_text(x), kws)


def tokens(x: str, clean: bool = True) -> str:
    """X22 token list: runs of letters and digits of lower-case text."""
    t = f"coalesce({x}, '')"
    if clean:
        t = f"translate({t}, '_#', ' ')"
    return f"list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def lexicon_values(entries=None) -> str:
    entries = entries or rules.DEFAULT_LEXICON
    seen = {}
    for w, p, s in entries:
        seen.setdefault(w, (float(p), float(s)))
    rows = ", ".join(f"({q(w)}, {p!r}::DOUBLE, {s!r}::DOUBLE)" for w, (p, s) in seen.items())
    return f"(VALUES {rows}) AS lex(word, polarity, subjectivity)"


def lexicon_scores(src: str, id_cols: str, text: str, entries=None) -> str:
    """Subquery: id_cols, pol, subj (only rows with a hit)."""
    return (f"(SELECT {id_cols}, avg(polarity) AS pol, avg(subjectivity) AS subj FROM "
            f"(SELECT {id_cols}, unnest({tokens(text, clean=False)}) AS w FROM {src}) tk "
            f"JOIN {lexicon_values(entries)} ON tk.w = lex.word GROUP BY {id_cols})")


def stop_words_list(stop_words=None) -> str:
    return str_list(stop_words if stop_words is not None else rules.default_stop_words())


def mask(x: str) -> str:
    """X10 in SQL: single-space tokens, '@x..' -> '@user', 'http..' -> 'http'."""
    return (f"array_to_string(list_transform(string_split(coalesce({x}, ''), ' '), "
            "lambda w: CASE WHEN starts_with(w, '@') AND length(w) > 1 THEN '@user' "
            "WHEN starts_with(w, 'http') THEN 'http' ELSE w END), ' ')")


def windows_sql(src: str, id_cols: str, text: str, size: int, overlap: int) -> str:
    """Subquery: id_cols, w, window (token list) -- X10 + X19."""
    step = size - overlap
    return f"""(SELECT {id_cols}, CAST(s / {step} AS INTEGER) AS w, tk[s + 1:s + {size}] AS chunk FROM (
  SELECT {id_cols}, tk, unnest(range(0, greatest(len(tk) - {overlap} - 1, 0) + 1, {step})) AS s FROM (
    SELECT {id_cols}, {tokens(mask(text), clean=False)} AS tk FROM {src})))"""


def lexicon_logits_sql(win: str, entries=None) -> str:
    """Subquery over a windows subquery: adds logits [neg, 0.5, pos]."""
    entries = entries or rules.DEFAULT_LEXICON
    seen = {}
    for w, p, s in entries:
        seen.setdefault(w, float(p))
    neg = str_list([w for w, p in seen.items() if p < 0]) or "''"
    pos = str_list([w for w, p in seen.items() if p > 0]) or "''"
    return (f"(SELECT *, [CAST(len(list_filter(chunk, lambda t: t IN ({neg}))) AS DOUBLE), 0.5, "
            f"CAST(len(list_filter(chunk, lambda t: t IN ({pos}))) AS DOUBLE)] AS logits FROM {win})")


def argmax_polarity_sql(logits: str) -> str:
    return f"(list_position({logits}, list_max({logits})) - 2)"


def vote_sql(src: str, id_cols: str, text: str, size: int, overlap: int, entries=None) -> str:
    """Subquery: id_cols, polarity (M7 with the lexicon scorer)."""
    win = windows_sql(src, id_cols, text, size, overlap)
    return (f"(SELECT {id_cols}, CAST(round_even(avg({argmax_polarity_sql('logits')}), 0) AS INTEGER) "
            f"AS polarity FROM {lexicon_logits_sql(win, entries)} GROUP BY {id_cols})")
