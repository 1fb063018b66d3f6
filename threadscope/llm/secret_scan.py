"""Secret scans over a trigram inverted index.

From every rule's regex a Boolean query over trigrams is derived: literals that
must occur give conjunctions, alternatives give disjunctions, everything else is
no constraint.  Each slice of texts gets an inverted index (trigram -> rows) of the
trigrams that occur in the queries, over case-folded bytes; a rule's postings
are intersected and united as its query says, and only these candidates are
searched with the regex itself.  A rule without mandatory trigrams scans every
text.  The index lives with its slice inside the task, so texts never move.

Defined results: null and empty texts have no spans; spans count in code points of
the whole text, end exclusive; matches of one rule do not overlap, those of
different rules may.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 1      # characters that the group must have
    group: int = 0
    span: int = 0       # the group that is the secret's place


#: What may stand between the lines of a key: blanks, escaped line ends, quotes and marks of comments, lists and code.
GAP = r"""(?:\\[nrt]|[\s"'`,;+>|#*\\()\[\]])*+"""
#: From a key's header to the next END line of a private key, if no other block begins or ends before;
#: else its header fields and base64 lines, the last one of any length.
KEY_BODY = (r"(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
            rf"|(?:{GAP}(?:Proc-Type|Content-Domain|DEK-Info):\x20*[^\s\\]+)*+(?:{GAP}(?:[A-Za-z0-9+/]{{16,}}={{0,2}}|[A-Za-z0-9+/]+={{1,2}}))*+"
            r"""(?:[\x20\t"'+]*(?:\r?\n|\\r|\\n)(?:\r?\n|\\n|[\x20\t"'>])*+[A-Za-z0-9+/]{1,15}(?=[\x20\t]*(?:["'\r\n\\]|\Z)))?)""")

#: Kinds in the order in which spans at one place are listed; the first three are the base.
RULES = (
    Rule("assign", r"""(%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join(
        [*map(either_case, ["password", "passwd", "secret", "token"]), either_case("api") + "_?" + either_case("key")]), 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + KEY_BODY),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # both begin where a run of their characters begins, so a run is read once however long it is
    Rule("web_token", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+"
                      r"(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)", span=1),
    Rule("url_login", r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^\s:/@]++:[^\s:/@]++@)", span=1),
)
BASE = ("assign", "access", "hex")


# -- Boolean trigram queries --------------------------------------------------
# A query is a set of alternatives, each a set of trigrams that must all occur;
# {frozenset()} is no constraint.

ANY = frozenset([frozenset()])
#: Exact strings and alternatives beyond which a part counts as no constraint.
MOST = 64


def simplified(query: frozenset) -> frozenset:
    return frozenset(a for a in query if not any(b < a for b in query))


def both(p: frozenset, q: frozenset) -> frozenset:
    out = simplified(frozenset(a | b for a in p for b in q))
    return out if len(out) <= MOST else min(p, q, key=len)


def trigrams_of(strings: set[str]) -> frozenset:
    """Some one of the strings occurs."""
    grams = []
    for s in strings:
        raw = s.lower().encode()
        grams.append(frozenset(raw[i:i + 3] for i in range(len(raw) - 2)))
    return simplified(frozenset(grams))


def analysed(tree) -> tuple[set[str] | None, frozenset]:
    """(the strings it matches exactly, if few; a query all its matches satisfy)."""
    run, query, whole = {""}, ANY, True
    for op, arg in tree:
        exact, inner = analysed_item(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        query = both(both(query, trigrams_of(run)), inner)
        run, whole = exact or {""}, False
    return (run if whole else None), both(query, trigrams_of(run))


def analysed_item(op, arg) -> tuple[set[str] | None, frozenset]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is sre.IN:
        chars = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 8 else (None, ANY)
    if op is sre.SUBPATTERN:
        return analysed(arg[-1])
    if op is sre.BRANCH:
        parts = [analysed(p) for p in arg[1]]
        query = simplified(frozenset(a for _, q in parts for a in q))
        exact = set().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None
        return (exact if exact is not None and len(exact) <= MOST else None), query
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, part = arg
        exact, query = analysed(part)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, ANY
        if low == high == 1:
            return exact, query
        return None, (query if low else ANY)
    if op is sre.AT:
        return {""}, ANY
    return None, ANY


def trigram_query(pattern: str) -> frozenset | None:
    """Alternatives of trigrams of which one must occur whole; None: scan all."""
    _, query = analysed(list(sre_parse.parse(pattern)))
    return None if frozenset() in query else query


def searchable(rule: Rule) -> str:
    """A lone run of one class is searched with its least length: the same matches, none too short."""
    tree = list(sre_parse.parse(rule.pattern))
    lone = len(tree) == 1 and tree[0][0] is sre.MAX_REPEAT and tree[0][1][:2] == (1, sre.MAXREPEAT)
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if lone and not rule.group else rule.pattern


class TrigramIndex:
    """Postings of the wanted trigrams over a slice of texts."""

    def __init__(self, wanted: list[bytes]):
        self.wanted = {g: i + 1 for i, g in enumerate(wanted)}
        self.slot = np.zeros(1 << 24, dtype=np.uint8 if len(wanted) < 255 else np.uint16)
        for g, i in self.wanted.items():
            self.slot[g[0] << 16 | g[1] << 8 | g[2]] = i

    def build(self, raws: list[bytes]) -> dict[int, np.ndarray]:
        """slot -> sorted rows in which the trigram occurs."""
        data = np.frombuffer(b"\n\n".join(raws).lower(), dtype=np.uint8).astype(np.int32)
        if len(data) < 3:
            return {}
        found = self.slot[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(found)
        starts = np.cumsum([0, *(len(r) + 2 for r in raws[:-1])])
        rows = np.searchsorted(starts, at, side="right") - 1
        pairs = np.unique(found[at].astype(np.int64) * len(raws) + rows)
        slots, rows = pairs // len(raws), pairs % len(raws)
        edges = np.searchsorted(slots, np.arange(1, len(self.wanted) + 2))
        return {i: rows[edges[i - 1]:edges[i]] for i in self.wanted.values()}

    def candidates(self, postings: dict[int, np.ndarray], query: frozenset) -> np.ndarray:
        none = np.empty(0, dtype=np.int64)
        found = [none]
        for grams in query:
            lists = sorted((postings.get(self.wanted[g], none) for g in grams), key=len)
            rows = lists[0]
            for other in lists[1:]:
                if not len(rows):
                    break
                rows = np.intersect1d(rows, other, assume_unique=True)
            found.append(rows)
        return np.unique(np.concatenate(found))


class Scanner:
    #: Bytes of text that share one index.
    SLICE = 2 << 20

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [re.compile(searchable(r)) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = TrigramIndex(sorted({g for q in self.queries if q for a in q for g in a}))

    def matches(self, k: int, text: str):
        rule = self.rules[k]
        for m in self.compiled[k].finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                yield m.start(rule.span), k, m.end(rule.span)

    def scan(self, texts: list[str | None]) -> list[list[dict]]:
        out: list[list] = [[] for _ in texts]
        begin, size = 0, 0
        raws = []
        for i, text in enumerate(texts):
            raws.append((text or "").encode())
            size += len(raws[-1])
            if size >= self.SLICE or i == len(texts) - 1:
                self._slice(texts, begin, raws, out)
                begin, size, raws = i + 1, 0, []
        return [[{"kind": self.rules[k].kind, "start": a, "end": b} for a, k, b in sorted(found)] for found in out]

    def _slice(self, texts, begin, raws, out) -> None:
        postings = self.index.build(raws)
        for k, query in enumerate(self.queries):
            rows = range(len(raws)) if query is None else self.index.candidates(postings, query).tolist()
            for r in rows:
                if raws[r]:
                    out[begin + r].extend(self.matches(k, texts[begin + r]))


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One scanner a Python worker and rule set."""
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def scan(df: DataFrame, text_col: str = "text", spans_col: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Append ``spans_col``: (kind, start, end) by start, then kind as listed; a column of that name is replaced."""
    df = df.drop(spans_col)
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(spans_col, T.ArrayType(SPAN))])

    def run(batches):
        s = scanner(rules)
        for batch in batches:
            spans = pa.array(s.scan(batch.column(at).to_pylist()), ARROW_SPANS)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], names=[*batch.schema.names, spans_col])

    return df.mapInArrow(run, schema)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns with every span (overlapping ones united) replaced by ``mark``."""
    at = df.columns.index(text_col)

    def run(batches):
        s = scanner(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(s.scan(texts)):
                if spans:
                    out, end = [], 0
                    for span in spans:
                        if span["start"] >= end:
                            out += [texts[i][end:span["start"]], mark]
                        end = max(end, span["end"])
                    texts[i] = "".join([*out, texts[i][end:]])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
