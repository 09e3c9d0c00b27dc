"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded over the tree.

A page is read into block nodes (inline elements only add text to their block).  Each node gets
features of its subtree (text, links, marks, density), its attribute tokens, its depth and its
siblings; the trees give its log odds of being main text.  The decoding then chooses, over the whole
tree at once, the set of nodes of highest value in which a kept node never stands below a dropped
one: the value of keeping a node is its own evidence plus that of the children worth keeping.

The trees are fitted here, on the nodes of a bounded sample of the pages.  Their labels come from
the pages themselves: nodes in or below elements that name their role (tag, role, class or id) are
main text or not; nodes without such evidence aren't used.  Each node is also shown without its
names, so that density, links and siblings decide where a page names nothing.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import Trees, fit_trees
from .common import ship, text_or_empty

#: Bound of the training sample, in pages (those of least hashed page_id).
SAMPLE_PAGES = 600

# Element names of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are read like others and dropped at their end tag; one that isn't ended in its block counts as empty.
DROPPED = set("noscript template svg math select object".split())
FOREIGN = {"svg", "math"}
BLOCK = set("""html head body article section main nav aside header footer div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6
    table caption thead tbody tfoot tr td th form fieldset legend button label blockquote pre figure figcaption address details
    summary dialog menu hgroup center""".split())
CLOSES_P = BLOCK - {"html", "head", "body", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "legend", "button", "label", "summary"}
#: Start tags that end an open element of these names, up to the nearest of the scope.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
        "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, {"html"})}
# Names by which pages mark what isn't, and what is, main text
SIDE_TAGS = set("nav footer aside form button label fieldset dialog menu".split())
SIDE_TOKENS = set("""nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottom copyright colophon
    sidebar side aside widget ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie
    cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search form share sharing social
    related recommended comment comments reply replies respond disqus discussion pagination pager tags hidden skip toolbar
    complementary contentinfo""".split())
MAIN_TAGS = set("article main".split())
MAIN_TOKENS = set("article main content post entry story".split())
TAG_KINDS = ["p", "div", "section", "li", "ul", "td", "blockquote", "pre", "h"]

#: A comment, a declaration, or the start of a tag; its attributes follow.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
#: An attribute: a quote delimits a value only right after the equals sign, elsewhere it is a character.
_ATTRIBUTE = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+"""
ATTRIBUTE = re.compile(_ATTRIBUTE)
ATTRIBUTES = re.compile(rf"(?:[\s/]++|{_ATTRIBUTE.replace('([', '(?:[')})*+")
NAMED = {"class", "id", "role", "hidden", "aria-hidden"}
WORD = re.compile(r"[a-z0-9]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I | re.A) for t in RAW}


class Page:
    """Block nodes of a page in page order, as parallel lists."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.nth = ["#root"], [-1], [0], [0]
        self.side, self.main = [0], [0]
        self.text: list[list[str]] = [[]]
        self.link = [0]
        self.end = [0]
        self.children = [0]
        #: Pieces of text in page order: (node, raw text, new block before it).
        self.pieces: list[tuple[int, str]] = []
        self._read(source)

    def _open(self, tag: str, attributes: str) -> int:
        i, up = len(self.tag), self.stack[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.nth.append(self.children[up])
        self.children[up] += 1
        self.children.append(0)
        self.link.append(0)
        self.end.append(i)
        side, main = tag in SIDE_TAGS, tag in MAIN_TAGS
        if tag == "header":
            side = not self.above_main[-1]
        if attributes:
            for name, *values in ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name not in NAMED:
                    continue
                value = "".join(values).lower()
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    side = True
                elif name in ("class", "id", "role"):
                    words = WORD.findall(value)
                    side = side or any(w in SIDE_TOKENS for w in words)
                    main = main or any(w in MAIN_TOKENS for w in words)
        self.side.append(int(side))
        self.main.append(int(main and not side))
        self.above_main.append(self.above_main[-1] or bool(self.main[-1]))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(i)
        return i

    def _shorten(self, k: int) -> None:
        """Take the nodes from position k of the stack on off it."""
        for i in reversed(self.stack[k:]):
            if self.places.get(self.tag[i]):
                self.places[self.tag[i]].pop()
        del self.stack[k:]
        del self.above_main[k:]

    def _close_to(self, k: int) -> None:
        """Close the open nodes from position k of the stack on."""
        for i in self.stack[k:]:
            self.end[i] = len(self.tag) - 1
        self._shorten(k)

    def _nearest(self, names) -> int:
        """Highest position of an open element of these names; 0 if none is open."""
        return max((self.places[t][-1] for t in names if self.places.get(t)), default=0)

    def _within(self, names: set, scope: set) -> int:
        k = self._nearest(names)
        return k if k > max(self._nearest(scope), self.drops[-1][1] - 1 if self.drops else 0) else 0

    def _say(self, raw: str) -> None:
        if not raw or raw.isspace():
            if raw and self.pieces:
                self.pieces.append((-1, " "))
            return
        i = self.stack[-1]
        self.pieces.append((i, raw))
        if self.links:
            self.linked.append((len(self.pieces), i, len(raw)))

    def _begin_drop(self, tag: str) -> None:
        self.drops.append((tag, len(self.stack), len(self.tag), self.children[self.stack[-1]], len(self.pieces), self.links))
        self.dropping[tag] += 1

    def _end_drop(self, tag: str) -> None:
        """Take back all that was read since the last open ``tag``."""
        if not self.dropping[tag]:
            return
        while True:
            name, depth, nodes, children, pieces, links = self.drops.pop()
            self.dropping[name] -= 1
            if name == tag:
                break
        self._shorten(depth)
        for of_nodes in (self.tag, self.parent, self.depth, self.nth, self.side, self.main, self.link, self.end, self.children):
            del of_nodes[nodes:]
        self.children[self.stack[-1]] = children
        del self.pieces[pieces:]
        while self.linked and self.linked[-1][0] > pieces:
            self.linked.pop()
        self.links = links

    def _read(self, source: str) -> None:
        self.stack, self.links, at = [0], 0, 0
        #: Positions in the stack of the open elements of each name; whether a node of the stack is or is below main text.
        self.places: dict[str, list[int]] = {}
        self.above_main = [False]
        #: Text in links, as (pieces up to it, node, length), and the open elements of DROPPED.
        self.linked, self.drops, self.dropping = [], [], Counter()
        while True:
            m = TOKEN.search(source, at)
            if not m:
                self._say(source[at:])
                break
            self._say(source[at:m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            at = ATTRIBUTES.match(source, at).end()
            attributes = source[m.end():at]
            if at >= len(source):
                break  # an unfinished tag ends the page
            at += 1
            if m[1]:
                if tag == "a":
                    self.links = max(0, self.links - 1)
                elif tag in BLOCK:
                    k = self._nearest([tag])
                    if k:
                        while self.drops and k < self.drops[-1][1]:
                            self.dropping[self.drops.pop()[0]] -= 1
                        self._close_to(k)
                        self.links = 0
                    self.pieces.append((-2, ""))
                elif tag in DROPPED:
                    self._end_drop(tag)
            elif attributes.endswith("/") and (tag in FOREIGN or tag in RAW and any(self.dropping[t] for t in FOREIGN)):
                continue
            elif tag in RAW:
                end = RAW_END[tag].search(source, at)
                if not end:
                    break  # the rest of the page belongs to an element that never ends
                at = end.end()
            elif tag in DROPPED:
                self._begin_drop(tag)
            elif tag in ("option", "optgroup"):
                at = source.find("<", at)
                if at < 0:
                    break
            elif tag == "a":
                self.links = 1
            elif tag in ("br", "hr"):
                self.pieces.append((-2, "") if tag == "hr" else (-1, " "))
            elif tag in BLOCK:
                if tag in CLOSES_P and (k := self._within({"p"}, {"td", "th", "button", "table"})):
                    self._close_to(k)
                if tag in ENDS and (k := self._within(*ENDS[tag])):
                    self._close_to(k)
                if tag in ("html", "body") and tag in self.tag:
                    continue
                self._open(tag, attributes)
                self.pieces.append((-2, ""))
        self._close_to(0)
        for _, i, n in self.linked:
            self.link[i] += n

    def blocks(self, kept) -> list[str]:
        """The kept text, a string for each block."""
        out, now, holder = [], [], -1

        def flush():
            text = " ".join(html_lib.unescape("".join(now)).split())
            if text:
                out.append(text)
            now.clear()

        for i, raw in self.pieces:
            if i == -2 or i >= 0 and i != holder:
                flush()
                holder = i if i >= 0 else -1
            if i == -1:
                now.append(raw)
            elif i >= 0 and kept[i]:
                now.append(raw)
        flush()
        return out


N_FEATURES = 24 + len(TAG_KINDS)


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, features) of all pages, one after the other, and the own text length of each node."""
    size = np.array([len(p.tag) for p in pages])
    start = np.concatenate(([0], np.cumsum(size)))
    n = int(start[-1])
    base = np.repeat(start[:-1], size)
    col = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.float64)
    own, marks, words = np.zeros(n), np.zeros(n), np.zeros(n)
    for s, p in zip(start, pages):
        for i, raw in p.pieces:
            if i >= 0:
                own[s + i] += len(raw)
                marks[s + i] += raw.count(".") + raw.count(",")
                words[s + i] += raw.count(" ") + 1
    end = (col("end") + base).astype(np.int64)
    up = (np.maximum(col("parent"), 0) + base).astype(np.int64)
    link, side, main, depth = col("link"), col("side"), col("main"), col("depth")
    at = np.arange(n)

    def subtree(x):
        run = np.concatenate(([0], np.cumsum(x)))
        return run[end + 1] - run[at]

    t_text, t_link, t_marks, t_words, t_tags = subtree(own), subtree(link), subtree(marks), subtree(words), end - at + 1.0
    above_side, above_main = np.zeros(n), np.zeros(n)
    by_depth = np.argsort(depth, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(depth[by_depth])) + 1, n)
    for a, z in zip(ends, ends[1:]):  # from depth 1 on
        here = by_depth[a:z]
        above_side[here] = np.maximum(above_side[up[here]], side[up[here]])
        above_main[here] = np.maximum(above_main[up[here]], main[up[here]])
    siblings = np.bincount(up, minlength=n)[up].astype(float)
    total = np.repeat(t_text[start[:-1]], size)
    before = np.concatenate(([0], np.cumsum(own)))[:-1]
    before = before - np.repeat(before[start[:-1]], size)
    some = np.maximum(t_text, 1)
    kinds = [t if t in TAG_KINDS else "h" if t[0] == "h" and t[1:].isdigit() else "ul" if t == "ol" else "td" if t == "th" else "" for p in pages for t in p.tag]
    kind = np.array([TAG_KINDS.index(k) if k else -1 for k in kinds])
    x = np.column_stack([
        side, main, above_side, above_main, depth, col("nth"), siblings, col("nth") / np.maximum(siblings, 1),
        np.log1p(t_text), np.log1p(own), np.log1p(t_words), np.log1p(t_tags), np.log1p(t_text / t_tags), t_link / some, link / np.maximum(own, 1),
        t_marks / np.maximum(t_words, 1), marks, t_text / np.maximum(t_text[up], 1), t_text / np.maximum(total, 1), before / np.maximum(total, 1),
        t_text / np.maximum(t_words, 1), np.log1p(t_text[up] / np.maximum(siblings, 1)), t_link[up] / np.maximum(t_text[up], 1), own / some,
        *(kind == k for k in range(len(TAG_KINDS)))])
    return x, own


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 below (or in) an element named main text, 0 in or below one named otherwise, -1 unknown."""
    out = np.full(len(x), -1)
    out[(x[:, 1] + x[:, 3]) > 0] = 1
    out[(x[:, 0] + x[:, 2]) > 0] = 0
    return out


def fit_pages(sources: list[str]) -> Trees | None:
    pages = [Page(s) for s in sources]
    x, own = features(pages) if pages else (np.zeros((0, N_FEATURES)), np.zeros(0))
    y = weak_labels(x) if len(x) else np.zeros(0)
    use = np.flatnonzero((y >= 0) & (x[:, 10] > 0))
    if len(set(y[use])) < 2:
        return None
    x, y = x[use], y[use].astype(float)
    # three views of each node: as it is; without names, so that structure decides where nothing is
    # named; and with another node's structure, so that names decide wherever they stand, also for
    # a part of another role inside the main text
    hidden, named = x.copy(), x.copy()
    hidden[:, :4] = 0
    rng = np.random.Generator(np.random.PCG64(5))
    named[:, 4:] = x[rng.permutation(len(x)), 4:]
    y_named = y.copy()
    inside = np.flatnonzero((y == 1) & (rng.random(len(x)) < 0.4))
    named[inside, np.where(rng.random(len(inside)) < 0.5, 0, 2)] = 1
    y_named[inside] = 0
    weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-6), 0.5 / max((y == 0).mean(), 1e-6))
    return fit_trees(np.concatenate([x, hidden, named]), np.concatenate([y, y, y_named]), np.concatenate([weight, 0.5 * weight, 2 * weight]))


def _by_names(x: np.ndarray) -> np.ndarray:
    """Log odds where no trees could be fitted: by names, then by text and links."""
    return np.where(weak_labels(x) == 0, -4.0, np.where(weak_labels(x) == 1, 4.0, 0.5 - 4 * x[:, 13] + 0.2 * (x[:, 8] - 4)))


def decode(page: Page, odds: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Kept nodes: the set of highest value that holds the parent of each of its nodes.

    Kept nodes count their own text and, by a half, that of their subtree, times their log odds."""
    n = len(page.tag)
    end = np.array(page.end)
    run = np.concatenate(([0], np.cumsum(own)))
    below = run[end + 1] - run[np.arange(n)]
    neutral = np.array([t in ("#root", "html", "body") for t in page.tag])
    value = np.where(neutral, 0.0, odds * (own + 0.5 * below))
    for i in range(n - 1, 0, -1):
        if value[i] > 0:
            value[page.parent[i]] += value[i]
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and value[i] > 0 and page.tag[i] != "head"
    loose = neutral & kept & (own > 0)
    # text that stands in no block at all: main text only if its own odds say so
    kept_text = kept.copy()
    kept_text[loose] = odds[loose] > 0
    return kept_text


def extract(sources: list[str], trees: Trees | None) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    x, own = features(pages)
    odds = trees.log_odds(x) if trees is not None else _by_names(x)
    out, at = [], 0
    for p in pages:
        n = len(p.tag)
        out.append("\n\n".join(p.blocks(decode(p, odds[at:at + n], own[at:at + n]))))
        at += n
    return out


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Trees | None:
    """Trees fitted, in one task, on at most ``sample`` pages (of least hashed page_id and url)."""
    ship(pages.sparkSession)
    ids = (pages.where("html IS NOT NULL").select("page_id", F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), "url")).alias("rank"))
           .orderBy("rank").limit(sample).groupBy("page_id").agg(F.min("rank").alias("rank")))
    rows = pages.select("page_id", "html").where("html IS NOT NULL").join(F.broadcast(ids), "page_id")

    def fit(group: pa.Table) -> pa.Table:
        ordered = group.sort_by([("rank", "ascending"), ("html", "ascending")]).slice(0, sample)
        t = fit_pages(ordered["html"].to_pylist())
        if t is None:
            return pa.table({"part": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})
        width = max(len(e) for e in t.edges)
        edges = np.array([np.append(e, np.full(width - len(e), np.inf)) for e in t.edges])
        parts = [edges, np.array([t.base]), t.feature.astype(float), t.cut.astype(float), t.leaf]
        return pa.table({"part": pa.array(range(5), pa.int32()), "body": pa.array([p.tobytes() for p in parts], pa.binary())})

    got = {r.part: np.frombuffer(r.body) for r in rows.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "part int, body binary").collect()}
    if not got:
        return None
    edges = [e[np.isfinite(e)] for e in got[0].reshape(N_FEATURES, -1)]
    n = len(got[4]) // 8
    return Trees(edges, float(got[1][0]), got[2].reshape(n, -1).astype(np.int64), got[3].reshape(n, -1).astype(np.int64), got[4].reshape(n, -1))


def main_texts(pages: DataFrame, trees: Trees | None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html, ...).

    Whole pages are read; character references are decoded, white space within a block becomes one
    space, and blocks are joined in page order by two line ends.  A null or empty page has the empty
    text; page_id and url are passed on, null or not; repeated rows give a row each; without trees
    the names of the elements decide; other columns are not read; an empty table gives an empty
    result."""
    spark = pages.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(trees)  # of fixed size

    def run(batches):
        for batch in batches:
            sources = batch.column("html").to_pylist()
            texts = []
            for a in range(0, len(sources), 256):
                texts += extract(sources[a:a + 256], model.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
