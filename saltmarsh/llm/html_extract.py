"""Main text of web pages: a tree-structured graphical model over the DOM.

Block elements are the nodes of a tree; each is content or not. A node's potential sums weights of
its features (tag, words of class, id and role, amount of text, share of links, punctuation), and an
edge's potential is a 2 by 2 table for the child's kind of tag. Sum-product message passing, upward
and then downward, gives the marginals exactly; the weights are trained by the likelihood of labelled
pages, whose gradient comes from the same marginals. A batch of pages is one forest, level by level.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.html_training import labelled_pages

BLOCKS = frozenset(
    """address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section select summary
    table tbody td tfoot th thead tr ul caption""".split()
)
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())  # text up to their end tag
HIDDEN = frozenset("template noscript svg object canvas audio video".split())  # left out with what is in them; they end with their parent at the latest
#: An element of the key ends these open ones, if none of the last ones stands between.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th", "p"}, {"table"}),
    "tfoot": ({"tbody", "tr", "td", "th", "p"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
KINDS = {t: i for i, t in enumerate(["div", "p", "li", "ul", "ol", "section", "article", "main", "aside", "nav", "header", "footer", "table", "td", "blockquote", "form", "h1", "h2", "h3"], 1)}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
MARKS = ".!?…。！？"


class Page:
    """The block tree of a page: parents (-1: none), depths, features, labels of training pages, and text segments."""

    def __init__(self, source: str, labelled: bool = False):
        self.labelled = labelled  # whether ``data-y`` says what is content
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.depths: list[int] = []
        self.attributes: list[str] = []
        self.labels: list[int] = []
        self.segments: list[tuple[int, str]] = []
        self.open: Counter[str] = Counter()  # open blocks by tag, but for the root
        self.links: list[int] = []  # characters of each segment that are in links
        self._parse(source)

    def _open(self, tag: str, attributes: str, stack: list[int]) -> None:
        parent = stack[-1] if stack else -1
        self.tags.append(tag)
        self.parents.append(parent)
        self.depths.append(len(stack))
        words, label = "", self.labels[parent] if parent >= 0 else 0
        if "=" in attributes:
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name in ("class", "id", "role"):
                    words += " " + value
                elif name == "data-y" and self.labelled:
                    label = int(value)
        self.attributes.append(words)
        self.labels.append(label)
        if stack:
            self.open[tag] += 1
        stack.append(len(self.tags) - 1)

    def _parse(self, source: str) -> None:
        stack: list[int] = []
        self._open("html", "", stack)
        run: list[str] = []
        linked = 0
        link: int | None = None  # the block in which a link is open
        at = 0
        hidden: list[str] = []  # the open hidden element, and the blocks and hidden ones in it

        def shown(tag: str, closing: str) -> bool:
            """Whether a tag in a hidden element ends it and counts as one behind it; otherwise keeps account of it."""
            if closing:
                if tag in hidden:
                    del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
                    return False
                return tag in ("body", "html") or self.open[tag] > 0
            while hidden and hidden[-1] == "svg" and tag in BLOCKS:  # no svg holds one
                del hidden[-1]
            if not hidden:
                return True
            ended, fences = ENDS.get(tag, ((), ()))
            for name in chain(reversed(hidden[1:]), (tags[stack[k]] for k in range(len(stack) - 1, 0, -1))) if any(map(self.open.get, ended)) else ():
                if name in fences:
                    break
                if name in ended:
                    return not any(x in ended for x in hidden)
            return False

        def end_run() -> None:
            nonlocal linked
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    self.segments.append((stack[-1], text))
                    self.links.append(min(linked, len(text)))
                run.clear()
            linked = 0

        def pop_to(size: int) -> None:
            nonlocal link
            end_run()
            for k in stack[size:]:
                self.open[tags[k]] -= 1
            del stack[size:]
            if link is not None and link >= size:
                link = None

        tags, found = self.tags, TAG.search(source)
        while found:
            if found.start() > at:
                if not hidden:
                    run.append(text := source[at : found.start()])
                    if link is not None:
                        linked += len(text)
            at = found.end()
            tag = found[2] or found[5]
            if tag:
                tag, closing, attributes = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
                if hidden and shown(tag, closing):
                    hidden.clear()
                if tag in RAW and not closing and not attributes.endswith("/"):
                    end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = end.end() if end else len(source)
                elif hidden or tag in HIDDEN:
                    if not closing and not attributes.endswith("/") and (tag in HIDDEN or tag in BLOCKS or tag == "foreignobject"):
                        hidden.append(tag)
                elif tag == "br":
                    run.append(" ")
                elif tag == "hr":
                    end_run()
                elif tag == "a":
                    link = None if closing else len(stack) - 1
                elif tag in ("html", "body"):
                    end_run()
                    if tag == "body" and not closing and len(stack) == 1:
                        self._open(tag, attributes, stack)
                    elif tag == "html" and not closing and len(tags) == 1 and attributes:
                        self.open.clear(), tags.clear(), self.parents.clear(), self.depths.clear(), self.attributes.clear(), self.labels.clear(), stack.clear()
                        self._open(tag, attributes, stack)
                elif tag in BLOCKS:
                    if closing:
                        k = len(stack) - 1
                        while self.open[tag] and tags[stack[k]] != tag:
                            k -= 1
                        pop_to(k if self.open[tag] else len(stack))
                    else:
                        ended, fences = ENDS.get(tag, ({"p"}, BLOCKS - {"p"}))
                        cut, left = len(stack), sum(self.open[x] for x in ended)
                        for k in range(len(stack) - 1, 0, -1):
                            if not left or tags[stack[k]] in fences:
                                break
                            if tags[stack[k]] in ended:
                                cut, left = k, left - 1
                        pop_to(cut)
                        self._open(tag, attributes, stack)
            found = TAG.search(source, at)
        if at < len(source) and not hidden:
            run.append(source[at:])
            if link is not None:
                linked += len(source) - at
        end_run()

    def features(self) -> list[list[str]]:
        n = len(self.tags)
        own, own_links, marks, total, links = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        for (node, text), linked in zip(self.segments, self.links, strict=True):
            own[node] += len(text)
            own_links[node] += linked
            marks[node] += sum(map(text.count, MARKS))
        for i in range(n - 1, -1, -1):
            total[i] += own[i]
            links[i] += own_links[i]
            if self.parents[i] >= 0:
                total[self.parents[i]] += total[i]
                links[self.parents[i]] += links[i]
        out = []
        for i, tag in enumerate(self.tags):
            share = int(4 * links[i] / total[i]) if total[i] else 5
            names = ["bias", "tag " + tag, f"links {share}", f"{tag} links {share}"]
            if own[i]:
                names += [f"own {min(len(str(own[i])), 3)}", f"marks {min(marks[i], 3)}"]
            elif total[i]:
                names.append(f"inner {min(len(str(total[i])), 3)}")
            if self.parents[i] >= 0:
                names.append(f"under {self.tags[self.parents[i]]}")
            if self.attributes[i]:
                names += ["word " + w for w in set(re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", self.attributes[i]).lower()))]
            out.append(names)
        return out


class Forest:
    """The trees of some pages, ready for message passing."""

    def __init__(self, pages: list[Page], index: dict[str, int], learn: bool = False):
        sizes = [len(p.tags) for p in pages]
        self.first = np.cumsum([0, *sizes])
        base = np.repeat(self.first[:-1], sizes)
        parents = np.concatenate([np.array(p.parents) for p in pages]) if pages else np.zeros(0, np.int64)
        self.parent = np.where(parents < 0, -1, parents + base).astype(np.int64)
        depth = np.concatenate([np.array(p.depths) for p in pages]) if pages else np.zeros(0, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 2)) if len(depth) else []
        self.levels = np.split(order, cuts)[:-1] if len(depth) else []
        self.kind = np.array([KINDS.get(t, 0) for p in pages for t in p.tags], np.int64)
        nodes, which = [], []
        for i, names in enumerate(x for p in pages for x in p.features()):
            for name in names:
                k = index.setdefault(name, len(index)) if learn else index.get(name)
                if k is not None:
                    nodes.append(i)
                    which.append(k)
        self.node, self.which = np.array(nodes, np.int64), np.array(which, np.int64)

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent's state, own state) of each node that has a parent."""
        n = len(self.parent)
        local = np.zeros((n, 2))
        local[:, 1] = np.bincount(self.node, weights[self.which], n)
        up = local.copy()  # potential of a node with all that is below
        message = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            message[level] = np.logaddexp.reduce(edges[self.kind[level]] + up[level][:, None, :], axis=2)
            np.add.at(up, self.parent[level], message[level])
        down = up.copy()  # the same with all that is above: the log marginal, up to a constant
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            outside = down[self.parent[level]] - message[level]
            pair = edges[self.kind[level]] + outside[:, :, None] + up[level][:, None, :]
            pair -= np.logaddexp.reduce(pair.reshape(-1, 4), axis=1)[:, None, None]
            joint[level] = np.exp(pair)
            down[level] = np.logaddexp.reduce(pair, axis=1)
        return 1 / (1 + np.exp(np.clip(down[:, 0] - down[:, 1], -500, 500))), joint


class Extractor:
    """A trained model; ``text`` gives the main text of a page."""

    def __init__(self, steps: int = 300, l2: float = 0.1):
        pages = [Page(x, labelled=True) for x in labelled_pages()]
        self.index: dict[str, int] = {}
        forest = Forest(pages, self.index, learn=True)
        y = np.array([v for p in pages for v in p.labels])
        child = np.flatnonzero(forest.parent >= 0)
        seen = np.zeros((len(KINDS) + 1, 2, 2))
        np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
        w, e = np.zeros(len(self.index)), np.zeros_like(seen)
        size, n = len(w), len(pages)
        m, v = np.zeros(size + e.size), np.zeros(size + e.size)
        for step in range(1, steps + 1):
            p, joint = forest.marginals(w, e)
            expected = np.zeros_like(seen)
            np.add.at(expected, forest.kind[child], joint[child])
            grad = np.append(np.bincount(forest.which, (p - y)[forest.node], size) + l2 * w, (expected - seen + l2 * e).ravel()) / n
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, e = w - move[:size], e - move[size:].reshape(e.shape)
        self.weights, self.edges = w, e

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(x) for x in sources]
        forest = Forest(pages, self.index)
        p, _ = forest.marginals(self.weights, self.edges)
        return [" ".join(t for node, t in page.segments if p[at + node] >= 0.5) for page, at in zip(pages, forest.first, strict=False)]


@lru_cache(1)
def extractor() -> Extractor:
    """The model, trained once by the driver, from the same pages in the same order in every run."""
    return Extractor()


def extract_text(df: DataFrame, *, html_col: str = "html", batch: int = 64) -> DataFrame:
    """Add ``text``, a page's main text, and ``n_chars``, its code points, to each row.

    White space in a block becomes one space; blocks are joined in page order by one space. Null, empty and
    markup-free pages work: the first two give an empty text. Very long pages are read whole. Rows that repeat and null ids stay as they
    are; no rows give no rows. Columns of these names are replaced, others stay.
    """

    held = df.sparkSession.sparkContext.broadcast(extractor())

    @F.pandas_udf("string")
    def extracted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held.value
        for part in parts:
            sources = [x or "" for x in part]
            yield pd.Series([t for at in range(0, len(sources), batch) for t in model.texts(sources[at : at + batch])], dtype=object)

    df = df.drop("text", "n_chars")
    return df.withColumn("text", extracted(html_col)).withColumn("n_chars", F.length("text").cast("long"))
