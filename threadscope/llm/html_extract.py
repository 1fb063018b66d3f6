"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded as a tree.

A page becomes a tree of block elements (inline elements only mark links; scripts,
styles, comments, titles and the like carry no text).  Every node has features:
its tag, tokens of class, id and role, depth, text density of its subtree, links,
sentence marks, its place in the page and figures of its siblings and parent.  A
gradient-boosted classifier gives each node a chance of being article.  Decoding
chooses, for each subtree, between dropping it whole and keeping its root
and deciding on the children, whichever has the greater likelihood, so nothing is kept
under a dropped ancestor.

The classifier is fitted on the driver on a bounded sample (of the distinct pages of at
most FIT_CHARS characters that can be labelled, the FIT_PAGES with the least hash).
Its labels come from pages that say what is what by semantic tags, and from copies of these pages laid out anew
with plain containers, sidebars, notices, forms and reader comments, so that structure
and tokens are learnt and not one template.

Defined results: null and empty html give an empty text; unclosed elements end where
their parent ends or a block begins; a page without blocks is its text; the text is
whole, with white space as single spaces.
"""

from __future__ import annotations

import random
import re
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES, FIT_CHARS, COPIES, SEED = 300, 200_000, 3, 7

#: Elements without content, elements whose text is never shown, and inline elements (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe svg title select textarea button canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr object math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover "
                   "mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
                   "munderover semantics annotation annotation-xml".split())
#: A start tag of the key ends an open element of the value.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|title)\b.*?(?:</\1\s*>|\Z)"""
                   r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|data-y)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)

TAG_GROUPS = [{"article", "main"}, {"section"}, {"div", "body", "html"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"},
              {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"nav", "menu"}, {"header"}, {"footer", "address"}, {"aside"},
              {"form", "fieldset", "dialog"}, {"table", "tbody", "tr", "td", "th"}, {"blockquote", "pre", "figure", "figcaption"}]
#: Attribute tokens by kind: a token counts if it begins with one of these.
TOKEN_KINDS = [("article", "content", "main", "post", "entry", "story", "text", "body"),
               ("nav", "menu", "breadcrumb", "toolbar", "pager", "pagination", "tabs", "links"),
               ("header", "masthead", "topbar", "logo", "site-head", "top"),
               ("footer", "copyright", "bottom", "legal", "foot"),
               ("sidebar", "aside", "widget", "related", "recommend", "popular", "rail", "share", "social", "tags"),
               ("notice", "cookie", "consent", "alert", "newsletter", "subscribe", "gdpr", "message", "modal", "popup", "overlay"),
               ("ad", "ads", "advert", "sponsor", "promo", "banner", "advertisement"),
               ("form", "search", "login", "signup", "contact", "poll"),
               ("comment", "comments", "reply", "replies", "discussion", "responses", "disqus", "feedback")]
KIND_OF = re.compile("|".join(f"(?P<k{i}>{'|'.join(re.escape(w) for w in sorted(ws, key=len, reverse=True))})"
                              for i, ws in enumerate(TOKEN_KINDS)))


class Page:
    """Block nodes in document order (parents first) and the text in them."""

    def __init__(self, html: str | None):
        self.tag, self.parent, self.depth, self.kinds, self.hidden, self.mark = ["html"], [-1], [0], [0], [False], [None]
        self.first = [0]        # characters before the node
        self.own, self.linked, self.marks, self.inner = [0], [0], [0], [0]
        self.events: list[tuple[int, str]] = []
        if html:
            self._parse(html)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        kinds, hidden, mark = 0, False, None
        if attributes:
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id", "role"):
                    for token in re.split(r"[\s_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                        for part in (token, *token.split("-")):
                            if m := KIND_OF.match(part):
                                if len(m[0]) > 3 or len(part) <= len(m[0]) + 1:
                                    kinds |= 1 << int(m.lastgroup[1:])
                elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
                    hidden = True
                elif name == "data-y":
                    mark = int(value)
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.kinds.append(kinds)
        self.hidden.append(hidden)
        self.mark.append(mark)
        self.first.append(self.seen)
        for column in (self.own, self.linked, self.marks, self.inner):
            column.append(0)
        return len(self.tag) - 1

    def _text(self, raw: str, node: int, in_link: int) -> None:
        text = unescape(raw) if "&" in raw else raw
        n = len(text.strip())
        if n:
            self.seen += n
            self.own[node] += n
            self.marks[node] += text.count(".") + text.count(",")
            if in_link:
                self.linked[node] += n
        self.events.append((node, text))

    def _parse(self, html: str) -> None:
        self.seen = 0
        stack: list[tuple[str, int]] = [("html", 0)]  # (tag, block node it is in or is)
        held: dict[str, int] = {}  # open elements by tag, so that a stray end tag costs nothing
        blocks: list[int] = []  # places of the open elements that are not inline
        links = silent = 0
        end = 0

        def push(tag: str, node: int) -> None:
            if tag not in INLINE:
                blocks.append(len(stack))
            held[tag] = held.get(tag, 0) + 1
            stack.append((tag, node))

        def pop() -> str:
            nonlocal links, silent
            t, _ = stack.pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            held[t] -= 1
            links -= t == "a"
            silent -= t in SILENT
            return t

        for m in TOKEN.finditer(html):
            if m.start() > end and not silent:
                self._text(html[end:m.start()], stack[-1][1], links)
            end = m.end()
            if m[3] is None:
                continue
            tag = m[3].lower()
            node = stack[-1][1]
            if m[2]:
                if held.get(tag):
                    while True:
                        t = pop()
                        if t not in INLINE:
                            self.events.append((stack[-1][1], " "))
                        if t == tag:
                            break
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    self.events.append((node, " "))
                elif tag not in ("wbr", "img"):
                    self.inner[node] += 1
                continue
            if tag == "head":  # both its tags may be left out: what it holds is silent itself, anything else has ended it
                self.inner[node] += 1
                continue
            if tag in INLINE or tag in SILENT:
                push(tag, node)
                links += tag == "a"
                silent += tag in SILENT
                self.inner[node] += 1
                continue
            if tag in ("html", "body") and len(stack) > 1 and stack[1][0] == tag:
                continue
            while tag == "body" and len(stack) > 1 and (stack[-1][0] in INLINE or stack[-1][0] in SILENT):
                pop()
            if blocks and (stack[blocks[-1]][0] in ENDS.get(tag, ()) or stack[blocks[-1]][0] == "p"):
                for _ in range(len(stack) - blocks[-1]):
                    pop()
            node = self._open(tag, m[4], stack[-1][1]) if not silent else stack[-1][1]
            self.events.append((node, " "))
            push(tag, node)
        if end < len(html) and not silent:
            self._text(html[end:], stack[-1][1], links)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent, depth = np.array(self.parent), np.array(self.depth, dtype=float)
        sums = np.array([self.own, self.linked, self.marks, self.inner, [1] * n], dtype=float)
        for i in range(n - 1, 0, -1):
            sums[:, parent[i]] += sums[:, i]
        chars, linked, marks, inner, nodes = sums
        total, up = max(1.0, chars[0]), np.maximum(parent, 0)
        children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
        among = np.maximum(children[up], 1)
        child_chars = np.bincount(parent[1:], weights=chars[1:], minlength=n) if n > 1 else np.zeros(n)
        child_links = np.bincount(parent[1:], weights=linked[1:], minlength=n) if n > 1 else np.zeros(n)
        order = np.zeros(n)
        met: dict[int, int] = {}
        for i, p in enumerate(self.parent):
            order[i] = met.get(p, 0)
            met[p] = met.get(p, 0) + 1
        kinds = np.array(self.kinds)
        above = kinds.copy()
        groups = np.zeros((len(TAG_GROUPS), n))
        over = np.zeros((len(TAG_GROUPS), n))
        for i, t in enumerate(self.tag):
            g = GROUP_OF.get(t)
            if g is not None:
                groups[g, i] = 1
            if i:
                above[i] |= above[parent[i]]
                over[:, i] = np.maximum(over[:, parent[i]], groups[:, parent[i]])
        above = np.where(parent >= 0, above[up], 0)
        first = np.array(self.first, dtype=float)
        columns = [*groups, *(groups[:, up] * (parent >= 0)), *over[[0, 7, 8, 9, 10, 11]],
                   *((kinds >> k & 1) for k in range(len(TOKEN_KINDS))), *((above >> k & 1) for k in range(len(TOKEN_KINDS))),
                   np.array(self.hidden), depth, np.log1p(chars), np.log1p(np.array(self.own, dtype=float)),
                   linked / np.maximum(chars, 1), chars / (nodes + inner), marks / np.maximum(chars, 1) * 100,
                   np.log1p(children), np.log1p(among), order / among, chars / total, first / total,
                   np.log1p((child_chars[up] - chars) / among), chars / np.maximum(child_chars[up], 1),
                   child_links[up] / np.maximum(child_chars[up], 1), chars[up] / total]
        return np.stack([np.asarray(c, dtype=np.float32) for c in columns], axis=1)

    def decode(self, chance: np.ndarray) -> np.ndarray:
        """The likeliest kept set that holds every kept node's ancestors."""
        p = np.clip(chance, 1e-6, 1 - 1e-6)
        weight = np.log1p(np.array(self.own, dtype=float)) + 0.1
        keep, drop = weight * np.log(p), weight * np.log1p(-p)
        n = len(p)
        stay = keep.copy()     # node kept, children as is best
        gone = drop.copy()     # whole subtree dropped
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            stay[up] += max(stay[i], gone[i])
            gone[up] += gone[i]
        kept = np.zeros(n, dtype=bool)
        kept[0] = True
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and stay[i] > gone[i]
        return kept

    def text(self, kept) -> str:
        return " ".join("".join([t if kept[i] else " " for i, t in self.events]).split())


GROUP_OF = {t: g for g, tags in enumerate(TAG_GROUPS) for t in tags}


# -- gradient-boosted trees -------------------------------------------------------

class Boosted:
    """Logistic boosting of depth-limited trees over binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        score = np.zeros(len(y))
        self.model = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = w * (y - p), w * p * (1 - p)
            leaf = np.zeros(len(y), dtype=np.int64)
            splits = []
            for level in range(self.depth):
                size = 1 << level
                best = np.full(size, 1e-6)
                feature, cut = np.zeros(size, dtype=np.int64), np.full(size, self.bins)
                g_all, h_all = np.bincount(leaf, grad, size), np.bincount(leaf, hess, size)
                for f in range(x.shape[1]):
                    if not len(self.edges[f]):
                        continue
                    at = leaf * self.bins + b[:, f]
                    g = np.cumsum(np.bincount(at, grad, size * self.bins).reshape(size, self.bins), axis=1)
                    h = np.cumsum(np.bincount(at, hess, size * self.bins).reshape(size, self.bins), axis=1)
                    gain = (g ** 2 / (h + self.l2) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + self.l2)
                            - (g_all ** 2 / (h_all + self.l2))[:, None])
                    gain[(h < 1) | (h_all[:, None] - h < 1)] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(size), top] > best
                    best = np.where(better, gain[np.arange(size), top], best)
                    feature, cut = np.where(better, f, feature), np.where(better, top, cut)
                splits.append((feature, cut))
                leaf = 2 * leaf + (b[np.arange(len(y)), feature[leaf]] > cut[leaf])
            size = 1 << self.depth
            value = self.rate * np.bincount(leaf, grad, size) / (np.bincount(leaf, hess, size) + self.l2)
            self.model.append((splits, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        rows, score = np.arange(len(x)), np.zeros(len(x))
        for splits, value in self.model:
            leaf = np.zeros(len(x), dtype=np.int64)
            for feature, cut in splits:
                leaf = 2 * leaf + (b[rows, feature[leaf]] > cut[leaf])
            score += value[leaf]
        return 1 / (1 + np.exp(-score))


# -- labels -----------------------------------------------------------------------

ARTICLE_TAGS, OTHER_TAGS = {"article", "main"}, {"nav", "header", "footer", "aside", "form", "menu", "dialog", "address"}


def labels(page: Page) -> np.ndarray | None:
    """1 for article nodes and their ancestors, by marks or semantic tags; None if the page has neither."""
    n = len(page.tag)
    y = np.full(n, -1)
    for i in range(n):
        inherited = y[page.parent[i]] if i else -1
        if page.mark[i] is not None:
            y[i] = page.mark[i]
        elif page.tag[i] in OTHER_TAGS or page.kinds[i] & ~1 and inherited == 1:
            y[i] = 0
        elif page.tag[i] in ARTICLE_TAGS and inherited != 0:
            y[i] = 1
        else:
            y[i] = inherited
    if not (y == 1).any():
        return None
    for i in range(n - 1, 0, -1):
        if y[i] == 1 and y[page.parent[i]] == -1:
            y[page.parent[i]] = 2
        elif y[i] == 2:
            y[page.parent[i]] = max(y[page.parent[i]], 2) if y[page.parent[i]] != 1 else 1
    return np.where(y > 0, 1, 0)


def laid_out(blocks: list[str], pool: list[str], rng: random.Random) -> str:
    """A page of article blocks among other things, marked by data-y."""
    def some(k: int, most: int = 40) -> str:
        words = " ".join(rng.choice(pool) for _ in range(k)).split()
        at = rng.randrange(max(1, len(words) - most))
        return escape(" ".join(words[at:at + rng.randint(3, most)]))

    def box(names: str, inner: str, y: int, tags: str = "div") -> str:
        name, tag = rng.choice(names.split()), rng.choice(tags.split())
        attribute = rng.choice(["class", "id", "class"])
        bare = rng.random() < (0.3 if tag not in ("div", "section", "ul") else 0.08)
        return f'<{tag} data-y="{y}"' + ("" if bare else f' {attribute}="{name}"') + f">{inner}</{tag}>"

    def links(k: int) -> str:
        items = "".join(f'<li><a href="/x">{some(1, 4)}</a></li>' for _ in range(k))
        return f"<ul>{items}</ul>" if rng.random() < 0.7 else "".join(f'<a href="/x">{some(1, 4)}</a> ' for _ in range(k))

    def paragraphs(k: int) -> str:
        return "".join(f"<p>{some(2)}</p>" for _ in range(k))

    ad = lambda: box("ad ads advert advertisement sponsored promo ad-slot banner", some(1), 0, "div aside")
    others = {
        "header": lambda: box("header site-header masthead top-bar", some(1, 8) + links(rng.randint(0, 3)), 0, "header div"),
        "nav": lambda: box("nav menu navbar main-menu breadcrumbs", links(rng.randint(3, 9)), 0, "nav div ul"),
        "notice": lambda: box("notice cookie-notice alert consent newsletter subscribe", rng.choice([some(1), paragraphs(1)]), 0, "div section"),
        "ad": ad}
    after = {
        "sidebar": lambda: box("sidebar widget related recommended popular", rng.choice([links(5), paragraphs(2), f"<h3>{some(1, 5)}</h3>" + links(4)]), 0, "aside div section"),
        "comments": lambda: box("comments replies discussion responses comment-list", "".join(
            f'<div class="{rng.choice(["comment", "reply", "item"])}"><b>{some(1, 4)}</b>{paragraphs(rng.randint(1, 2))}</div>'
            for _ in range(rng.randint(1, 5))), 0, "section div ol"),
        "form": lambda: box("form search login contact signup", f"<label>{some(1, 5)}</label><input name=q>" + rng.choice(["", paragraphs(1)]), 0, "form"),
        "footer": lambda: box("footer site-footer copyright bottom", rng.choice([some(1), paragraphs(1), "&copy; " + some(1)]), 0, "footer div"),
        "notice": others["notice"], "ad": ad}
    body = []
    for i, b in enumerate(blocks):
        tag = "h1" if not i and rng.random() < 0.7 else rng.choice(["p", "p", "p", "p", "div", "blockquote", "h2"]) if len(b) < 120 else "p"
        body.append(f"<{tag}>{escape(b)}</{tag}>")
        if rng.random() < 0.05:
            body.append(rng.choice([ad, after["sidebar"], after["notice"]])())
    inside = "".join(body)
    if rng.random() < 0.3:
        inside += rng.choice([after["comments"], after["form"], after["sidebar"]])()
    tag = rng.choice(["article", "main", "div", "div", "section"])
    name = rng.choice(["content", "post", "entry", "article-body", "story", "text", "post-content", "main-content", "main", ""])
    main = f'<{tag} data-y="1"' + (f' class="{name}"' if name else "") + f">{inside}</{tag}>"
    before = [make() for make in others.values() if rng.random() < 0.55]
    behind = [make() for make in after.values() if rng.random() < 0.5]
    rng.shuffle(behind)
    page = "".join(before) + main + "".join(behind)
    if rng.random() < 0.5:
        page = f'<div class="{rng.choice(["wrap", "page", "container", "layout", "site"])}">{page}</div>'
    return f"<html><head><title>{some(1, 6)}</title></head><body>{page}</body></html>"


def training_pages(htmls: list[str], copies: int = COPIES, seed: int = SEED) -> list[tuple[Page, np.ndarray]]:
    rng = random.Random(seed)
    out, articles, pool = [], [], []
    for html in htmls:
        page = Page(html)
        y = labels(page)
        if y is None:
            continue
        out.append((page, y))
        blocks: dict[int, list[str]] = {}
        for i, t in page.events:
            blocks.setdefault(i, []).append(t)
        found = [(y[i], " ".join("".join(ts).split())) for i, ts in blocks.items()]
        articles.append([t for k, t in found if k == 1 and t])
        pool += [t for _, t in found if t]
    for blocks in articles:
        for _ in range(copies if pool else 0):
            some = blocks if rng.random() < 0.6 else blocks[:rng.choice([1, 2, 2, rng.randint(1, max(1, len(blocks)))])]
            page = Page(laid_out(some, pool, rng))
            out.append((page, labels(page)))
    return out


def sample(pages: DataFrame, html_col: str = "html") -> list[str]:
    """The FIT_PAGES distinct pages with the least hash of those that can be labelled.

    Pages are labelled in the tasks, by growing ranges of hashes, until enough are found."""
    usable = pages.select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html")).where(
        F.length("html").between(1, FIT_CHARS))

    def labelled(batches):
        for batch in batches:
            yield batch.filter(pa.array([labels(Page(h.as_py())) is not None for h in batch.column(1)], pa.bool_()))

    out: list[str] = []
    # first the hashes alone, so that tasks send no pages that are not wanted; copies of a page count once
    first = usable.select("h").distinct().orderBy("h").limit(2 * FIT_PAGES).agg(F.max("h"), F.count("*")).first()
    least, most = -(1 << 63), (1 << 63) - 1
    low, cut = least - 1, first[0] if first[1] == 2 * FIT_PAGES else most
    while first[1]:
        part = usable.where(F.col("h").between(low + 1, cut)).distinct().mapInArrow(labelled, usable.schema)
        out += [r.html for r in part.orderBy("h", "html").limit(FIT_PAGES - len(out)).collect()]
        if len(out) == FIT_PAGES or cut == most:
            break
        low, cut = cut, min(most, least + 4 * (cut - least + 1))
    return out


def fit(pages: DataFrame, html_col: str = "html") -> Boosted | None:
    """A classifier from a bounded sample; None if no page can be labelled."""
    htmls = sample(pages, html_col)
    rows = training_pages(htmls)
    if not rows:
        return None
    x = np.concatenate([p.features() for p, _ in rows])
    y = np.concatenate([y for _, y in rows]).astype(float)
    own = sum(labels(Page(h)) is not None for h in htmls)  # pages as they are come first and count threefold
    w = np.concatenate([np.full(len(y), 3.0 if i < own else 1.0) for i, (_, y) in enumerate(rows)])
    return Boosted().fit(x, y, w) if 0 < y.mean() < 1 else None


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """Replace the html by ``text_col``; a column of that name is replaced."""
    model = model or fit(pages, html_col)
    kept = [c for c in pages.columns if c not in (html_col, text_col)]
    schema = pages.select(*kept).schema.add(text_col, "string")

    def run(batches):
        for batch in batches:
            found = [Page(h.as_py()) for h in batch.column(len(kept))]
            if model is None or not found:
                texts = [p.text(np.ones(len(p.tag), dtype=bool)) for p in found]
            else:
                chance = model.predict(np.concatenate([p.features() for p in found]))
                ends = np.cumsum([len(p.tag) for p in found])
                texts = [p.text(p.decode(c)) for p, c in zip(found, np.split(chance, ends[:-1]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(texts, pa.string())], names=schema.names)

    return pages.select(*kept, html_col).mapInArrow(run, schema)
