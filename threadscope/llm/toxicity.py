"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

1. A sample of labelled documents (at most SAMPLE distinct texts of each label, those of least hash) is fetched.
   Words and word beginnings that toxic documents of the sample hold significantly more often mark the
   tokens of toxic documents: these are the labelled tokens.
2. A chain over two labels is fitted to them: weights for a token's word, beginnings and endings and for
   the words beside it, and for label pairs.  Gradients come from forward-backward marginals.
3. A third of the sample does not train the chain.  On it a logistic curve learns how the marginals of a document (their
   sum, their maximum, their mean) tell its label; classes count there as often as among all labelled documents.
4. All documents are tagged whole.  Marginals of at least half make spans with their code-point offsets.

Forward and backward messages run over blocks of BLOCK tokens at once: every block gives a 2 x 2 transfer matrix, these
are chained per document, and the messages inside follow; so one very long document costs no more than many short ones.

Defined results: null, empty and wordless texts have no spans and the score that a sum of nothing gives; repeated rows and texts get
equal scores (a text counts once in the sample); without examples of both labels, or in an empty table, scores are 0
and spans empty; rows without id never train and are never held out.  Columns of the input are returned unchanged; those that
clash with the columns added here are replaced.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct texts of each label in the sample (bound of the fit).
SAMPLE = {1: 1000, 0: 2500}
WORD = re.compile(r"\w+")
#: Lengths of word beginnings and endings, and of the longest word that is a feature itself.
HEADS, TAILS, LONGEST = range(2, 8), (3, 4), 32
#: A feature is used from so many documents and this likelihood-ratio statistic on; it marks tokens from these on,
#: with this share of toxic documents (both labels counted as equally frequent).
LEAST_DOCS, USED_G2 = 3, 6.0
MARKED_DOCS, MARKED_G2, MARKED_SHARE = 5, 18.0, 0.8
STEPS, RATE, RIDGE = 40, 0.5, 1e-5
BLOCK = 128
#: Distinct tokens a worker remembers before it starts anew.
MEMO_SIZE = 1 << 20


def features(word: str) -> list[str]:
    """The word in lower case (first, if not too long), its beginnings and its endings."""
    w = word.lower() if len(word) <= LONGEST else (word[:HEADS[-1]] + word[-TAILS[-1]:]).lower()
    out = [f"={w}" if len(word) <= LONGEST else "=",
           *[w[:k] + "-" for k in HEADS if len(w) >= k], *["-" + w[-k:] for k in TAILS if len(w) >= k]]
    return out


def blocks_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, valid, last): the token at each place of (BLOCK, blocks); whether there is one; whether the block ends its document."""
    count = -(-lengths // BLOCK)
    doc = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    inside = nth * BLOCK + np.arange(BLOCK)[:, None]
    valid = inside < lengths[doc]
    place = np.where(valid, np.repeat(np.cumsum(lengths) - lengths, count) + inside, 0)
    return place, valid, nth == count[doc] - 1


def carried(rows: np.ndarray, breaks: list[bool], start: tuple[float, float], order) -> tuple[np.ndarray, np.ndarray]:
    """The message before each block: ``start`` at a document's first block in this order, elsewhere the one before through the block's 2 x 2 matrix."""
    out = np.empty((2, rows.shape[1]))
    cells, state = rows.T.tolist(), start
    for i in order:
        if breaks[i]:
            state = start
        out[0, i], out[1, i] = state
        a, b, c, d = cells[i]
        x, y = state[0] * a + state[1] * c, state[0] * b + state[1] * d
        state = (x / (x + y), y / (x + y))
    return out[0], out[1]


def swept(move, w: np.ndarray, valid: np.ndarray, breaks: list[bool], start: tuple[float, float], forward: bool):
    """Messages (2, BLOCK, blocks) before each place in the direction of reading; ``move`` takes a message over one place.

    Every block is first swept from both unit messages, which gives its matrix, then from the message that reaches it."""
    n = w.shape[1]
    places = range(BLOCK) if forward else range(BLOCK - 1, -1, -1)
    a, b, c, d = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    for t in places:
        (a2, b2), (c2, d2) = move(a, b, w[t]), move(c, d, w[t])
        scale, ok = 1 / (a2 + b2 + c2 + d2), valid[t]
        a, b, c, d = (np.where(ok, new * scale, old) for new, old in ((a2, a), (b2, b), (c2, c), (d2, d)))
    x, y = carried(np.stack([a, b, c, d]), breaks, start, range(n) if forward else range(n - 1, -1, -1))
    out = np.empty((2, *w.shape))
    for t in places:
        out[0, t], out[1, t] = x, y
        x2, y2 = move(x, y, w[t])
        scale, ok = 1 / (x2 + y2), valid[t]
        x, y = np.where(ok, x2 * scale, x), np.where(ok, y2 * scale, y)
    return out


def forward_backward(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginals of label 1 for every token of documents laid end to end, from the log-odds ``e`` of each token;
    with ``pairs``, also the expected number of each pair of labels (before a document: label 0)."""
    if not len(e):
        return (e, np.zeros((2, 2))) if pairs else e
    place, valid, last = blocks_of(lengths)
    w = np.where(valid, np.exp(np.clip(e, -30, 30))[place], 1.0)
    (t00, t01), (t10, t11) = trans.tolist()
    first = np.concatenate([[True], last[:-1]])
    # forward: label weights of the token before; backward: of all that comes after a token
    before = swept(lambda x, y, o: (x * t00 + y * t10, (x * t01 + y * t11) * o), w, valid, first.tolist(), (1.0, 0.0), True)
    after = swept(lambda x, y, o: (x * t00 + y * o * t01, x * t10 + y * o * t11), w, valid, last.tolist(), (0.5, 0.5), False)
    clean, toxic = after[0], after[1] * w
    both = [before[i] * t * label for i, row in enumerate(trans.tolist()) for t, label in zip(row, (clean, toxic))]
    total = both[0] + both[1] + both[2] + both[3]
    p = np.empty(len(e))
    p[place[valid]] = ((both[1] + both[3]) / total)[valid]
    if not pairs:
        return p
    return p, np.array([(x / total)[valid].sum() for x in both]).reshape(2, 2)


def g_squared(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood-ratio statistic of a feature held by a of n1 and b of n0 documents."""
    total = (a + b) / (n1 + n0)
    out = np.zeros(len(a))
    for k, n in ((a, n1), (b, n0)):
        for x, q in ((k, total), (n - k, 1 - total)):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(x > 0, 2 * x * np.log(x / (n * q)), 0.0)
    return out


class Chain:
    """Fitted weights: of a token's features, of the words before and after, of label pairs; and the curve of the score."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.beside: dict[str, tuple[float, float]] = {}
        self.bias, self.trans = 0.0, np.ones((2, 2))
        self.curve = (0.0, 0.0, 0.0, 0.0)

    def token(self, word: str) -> tuple[float, float, float]:
        """Log-odds that a token gives itself, the token after it and the token before it."""
        found = features(word)
        get = self.weights.get
        return (self.bias + sum([get(f, 0.0) for f in found]), *self.beside.get(found[0], (0.0, 0.0)))

    def score(self, total: np.ndarray, most: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        x = self.curve[0] + summary(total, most, lengths) @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summary(total, most, lengths) -> np.ndarray:
    return np.stack([np.log1p(total), most, total / (lengths + 10)], axis=1)


def per_document(p: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and maximum of the marginals of each document."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    most = np.zeros(len(lengths))
    np.maximum.at(most, doc, p)
    return np.bincount(doc, p, minlength=len(lengths)), most


def fit_chain(texts: list[str], labels: np.ndarray, share: dict[int, float]) -> Chain | None:
    """Chain and curve from documents; every third calibrates.  ``share``: of each label among all labelled documents."""
    if len(set(labels.tolist())) < 2:
        return None
    types: dict[str, int] = {}
    docs = [np.array([types.setdefault(w.lower() if len(w) <= LONGEST else w, len(types)) for w in WORD.findall(t)], dtype=np.int64)
            for t in texts]
    names: dict[str, int] = {}
    entries = [[names.setdefault(f, len(names)) for f in features(w)] for w in types]
    own = np.array([x[0] for x in entries], dtype=np.int64)  # the word itself
    size = np.array([len(x) for x in entries], dtype=np.int64)
    flat, owner = np.array([f for x in entries for f in x], dtype=np.int64), np.repeat(np.arange(len(entries)), size)
    offset = np.cumsum(size) - size
    held = [np.zeros(len(names)), np.zeros(len(names))]
    for d, y in zip(docs, labels):
        seen = np.unique(d)
        k = size[seen]
        at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(offset[seen], k)
        held[y][np.unique(flat[at])] += 1
    n0, n1 = int((labels == 0).sum()), int((labels == 1).sum())
    g2 = g_squared(held[1], held[0], n1, n0)
    used = (held[0] + held[1] >= LEAST_DOCS) & (g2 >= USED_G2)
    share1 = held[1] / n1
    marks = used & (held[1] >= MARKED_DOCS) & (g2 >= MARKED_G2) & (share1 >= MARKED_SHARE * (share1 + held[0] / n0))
    kept = used[flat]
    number = np.cumsum(used) - 1
    flat, owner, marked_type = number[flat[kept]], owner[kept], np.bincount(owner, marks[flat]).astype(bool)
    n_types, n_used = len(types), int(used.sum())
    word = np.where(used[own], number[own], n_used)  # n_used: no feature

    trains = np.arange(len(docs)) % 3 != 2
    tokens = [d for d, t in zip(docs, trains) if t]
    lengths = np.array([len(d) for d in tokens], dtype=np.int64)
    ids = np.concatenate([*tokens, np.zeros(0, dtype=np.int64)])
    target = marked_type[ids] & (np.repeat(labels[trains], lengths) == 1)
    starts, stops = edges(lengths, len(ids))
    before, after = neighbours(ids, word, n_used, starts, stops)
    previous = np.concatenate([[0], target[:-1]]).astype(int)
    previous[starts] = 0
    seen_pairs = np.bincount(previous * 2 + target, minlength=4).reshape(2, 2)

    def emission(x: np.ndarray, ids, before, after) -> np.ndarray:
        self_, prev, next_ = x[:n_used], np.append(x[n_used:2 * n_used], 0), np.append(x[2 * n_used:3 * n_used], 0)
        return (x[-4] + np.bincount(owner, self_[flat], minlength=n_types))[ids] + prev[before] + next_[after]

    x = np.zeros(3 * n_used + 4)
    x[-4] = -2.0
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):  # Adam over the whole sample
        trans = transitions(x)
        p, expected = forward_backward(emission(x, ids, before, after), lengths, trans, pairs=True)
        diff = p - target
        by_type = np.bincount(ids, diff, minlength=n_types)
        g = np.concatenate([np.bincount(flat, by_type[owner], minlength=n_used), np.bincount(before, diff, minlength=n_used + 1)[:n_used],
                            np.bincount(after, diff, minlength=n_used + 1)[:n_used], [diff.sum()], (expected - seen_pairs).ravel()[1:]])
        g = g / max(1, len(ids)) + RIDGE * x
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        x = x - RATE * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-9)

    chain = Chain()
    used_names = [f for f, u in zip(names, used.tolist()) if u]
    chain.weights = dict(zip(used_names, x[:n_used].tolist()))
    chain.beside = {f: (a, b) for f, a, b in zip(used_names, x[n_used:2 * n_used].tolist(), x[2 * n_used:3 * n_used].tolist())
                    if f.startswith("=")}
    chain.bias, chain.trans = float(x[-4]), transitions(x)
    rest = [d for d, t in zip(docs, trains) if not t]
    lengths = np.array([len(d) for d in rest], dtype=np.int64)
    ids = np.concatenate([*rest, np.zeros(0, dtype=np.int64)])
    p = forward_backward(emission(x, ids, *neighbours(ids, word, n_used, *edges(lengths, len(ids)))), lengths, chain.trans)
    seen, y = summary(*per_document(p, lengths), lengths), labels[~trains]
    weight = np.array([share[v] / max(1, (y == v).sum()) for v in y.tolist()])
    chain.curve = logistic(seen, y, weight * len(y))
    return chain


def transitions(x: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(np.array([[0.0, x[-3]], [x[-2], x[-1]]]), -20, 20))


def edges(lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and the last tokens of documents."""
    some = lengths[lengths > 0]
    return np.cumsum(some) - some, np.cumsum(some) - 1


def neighbours(ids, word, nothing: int, starts, stops) -> tuple[np.ndarray, np.ndarray]:
    """Word features of the tokens before and after each."""
    before, after = np.roll(word[ids], 1), np.roll(word[ids], -1)
    before[starts], after[stops] = nothing, nothing
    return before, after


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Weighted logistic regression by Newton's steps on standardised columns."""
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.concatenate([np.ones((len(x), 1)), (x - middle) / scale], axis=1)
    b = np.zeros(z.shape[1])
    hold = ridge * np.eye(len(b))
    hold[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (p - y)) + hold @ b
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + hold
        b = b - np.clip(np.linalg.solve(h, g), -2, 2)
    slope = b[1:] / scale
    return (float(b[0] - (slope * middle).sum()), *slope.tolist())


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", text_col: str = "text",
        id_col: str = "doc_id") -> Chain | None:
    """Fit on the labelled rows whose id fulfils ``usable``; only ids and labels are taken from ``labels``."""
    marked = labels.where(F.col(label_col).isin(0, 1) & usable).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).distinct()
    texts = docs.where(usable & F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"),
                                                                  F.xxhash64(text_col).alias("__h"))
    hashes = texts.select("__id", "__h").join(marked, "__id").select("__label", "__h").distinct()
    counts = {r["__label"]: r["n"] for r in hashes.groupBy("__label").agg(F.count("*").alias("n")).collect()}  # two rows
    chosen = None
    for label, n in SAMPLE.items():
        least = hashes.where(F.col("__label") == label).orderBy("__h").limit(n)
        chosen = least if chosen is None else chosen.unionByName(least)
    found = (texts.select("__h", "__text").join(F.broadcast(chosen), "__h")  # at most SAMPLE rows
             .groupBy("__h", "__label").agg(F.min("__text").alias("text")).orderBy("__h", "__label").collect())
    total = sum(counts.values()) or 1
    return fit_chain([r["text"] for r in found], np.array([r["__label"] for r in found], dtype=np.int64),
                     {k: counts.get(k, 0) / total for k in (0, 1)})


class Tagger:
    """A chain in a worker, with the tokens it has met."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, 3))

    def numbers(self, words: list[str]) -> list[int]:
        known = self.number
        for w in words:
            if w in known:
                continue
            if len(known) == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[len(known)] = self.chain.token(w)
            known[w] = len(known)
        return list(map(known.__getitem__, words))

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """(scores, spans) of whole texts."""
        if len(self.number) > MEMO_SIZE:
            self.clear()
        ids = [self.numbers(WORD.findall(t)) if t else [] for t in texts]
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.array([i for x in ids for i in x], dtype=np.int64)
        e = self.table[flat, 0]
        starts, stops = edges(lengths, len(flat))
        give = np.roll(self.table[flat, 1], 1)  # what a token gives the one after it
        give[starts] = 0
        take = np.roll(self.table[flat, 2], -1)
        take[stops] = 0
        p = forward_backward(e + give + take, lengths, self.chain.trans)
        total, most = per_document(p, lengths)
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        spans = [spans_of(t, p[a:b]) if m >= 0.5 else [] for t, m, a, b in zip(texts, most, cuts, cuts[1:])]
        return self.chain.score(total, most, lengths), spans


def spans_of(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Code-point offsets of the runs of tokens with marginals of at least half."""
    out, before = [], -2
    for i, m in enumerate(WORD.finditer(text)):
        if p[i] >= 0.5:
            if before == i - 1:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
            before = i
    return out


def tag(df: DataFrame, chain: Chain | None, text_col: str = "text") -> DataFrame:
    """Append ``score`` and ``spans`` (array of start, end); columns of these names are replaced."""
    kept = [c for c in df.columns if c not in ("score", "spans")]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    if chain is None:
        return df.select(*kept, F.lit(0.0).alias("score"), F.array().cast(schema["spans"].dataType).alias("spans"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        tagger = Tagger(chain)
        for batch in batches:
            scores, spans = tagger.tag(batch.column(len(kept)).to_pylist())
            rows = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(scores, pa.float64()), rows], names=schema.names)

    return df.select(*kept, F.col(text_col).alias("__text")).mapInArrow(run, schema)
