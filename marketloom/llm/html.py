"""Main-text extraction from web pages by gradient-boosted trees over DOM-node features.

Each element of a page is a node with features of itself and its subtree: tag family, attribute tokens that speak for
content or for page furniture, depth, place among siblings, text and link density, and the marks of its ancestors.
Boosted trees (Spark ML) give each node the log odds of belonging to the main text. Hierarchical decoding then finds
the labelling of greatest total log odds in which no node is content below one that is not: a subtree is either
dropped whole or opened, so that ancestors and descendants never contradict each other.

The trees are trained on pages written by a generator of this module (documented bound: ``pages``), whose layouts have
the furniture of real pages: menus, headers, footers, sidebars, notices, adverts, forms, related links and comments,
with clean and with messy markup.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, struct_of

# fixed values: element families of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas select option textarea button".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# elements that an opening tag ends, and up to where
ENDS = {
    **dict.fromkeys(BLOCK, frozenset({"p"})),
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}),
}
FENCES = frozenset("ul ol dl table body html article section div aside nav main header footer form blockquote".split())
# attribute tokens
GOOD_TOKENS = frozenset("article content post entry main body story text page hentry prose maintext articlebody".split())
BAD_TOKENS = frozenset(
    "nav navigation menu header head footer foot sidebar side aside ad ads adv advert advertisement banner promo promotion sponsor sponsored cookie cookies consent notice notices alert popup modal overlay share sharing social comment comments reply replies respond disqus form login signin signup subscribe newsletter related recommended breadcrumb breadcrumbs copyright legal pagination pager toolbar widget tags meta byline search masthead skip gdpr paywall".split()
)
FAMILIES = ("p", "heading", "li", "list", "a", "div", "article", "main", "section", "nav", "aside", "header", "footer", "form", "table", "inline")
NUMBERS = (
    "good", "bad", "above_good", "above_bad", "above_content", "above_furniture", "depth", "index", "siblings", "log_text", "log_own", "share", "link_share", "log_links",
    "paragraphs", "mean_paragraph", "stops", "children", "list_items", "controls",
)
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset
    order: int
    parts: list = field(default_factory=list)  # text pieces and child numbers, in order


class Tree(HTMLParser):
    """Elements of a page; unclosed and crossed tags are repaired, and nothing is lost where the page is cut off."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("body", -1, 0, frozenset(), 0)]
        self.open = [0]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        ended = ENDS.get(tag)
        if ended:
            for k in range(len(self.open) - 1, 0, -1):
                name = self.nodes[self.open[k]].tag
                if name in ended:
                    del self.open[k:]
                    # a cell and its row may both have been open
                    if tag != "tr" or name == "tr":
                        break
                elif name in FENCES:
                    break
        top = self.open[-1]
        words: list[str] = []
        gold = None
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                words += re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())
            elif k == "data-gold":
                gold = v
        if gold:
            words.append("\0gold")
        node = Node(tag, top, self.nodes[top].depth + 1, frozenset(w for w in words if w), len(self.nodes))
        self.nodes.append(node)
        self.nodes[top].parts.append(node.order)
        if tag not in VOID:
            self.open.append(node.order)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.nodes[self.open[-1]].tag == tag and tag in ("svg", "path", "use", "rect", "circle"):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            name = self.nodes[self.open[k]].tag
            if name == tag:
                del self.open[k:]
                return
            if tag not in BLOCK and name in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        self.nodes[self.open[-1]].parts.append(data)


def parsed(page: str) -> list[Node]:
    tree = Tree()
    tree.feed(page)
    tree.close()
    return tree.nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node."""
    n = len(nodes)
    own, stops, links, text, linked, para, li, controls = (np.zeros(n) for _ in range(8))
    skipped = np.zeros(n, bool)
    anchor = np.zeros(n, bool)
    good, bad, a_good, a_bad, a_content, a_furniture = (np.zeros(n) for _ in range(6))
    index, siblings, kids = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, v in enumerate(nodes):
        up = v.parent
        skipped[i] = v.tag in HIDDEN or (up >= 0 and skipped[up])
        anchor[i] = v.tag == "a" or (up >= 0 and anchor[up])
        good[i], bad[i] = len(v.tokens & GOOD_TOKENS), len(v.tokens & BAD_TOKENS)
        if up >= 0:
            a_good[i], a_bad[i] = a_good[up] + (good[up] > 0), a_bad[up] + (bad[up] > 0)
            a_content[i] = a_content[up] or nodes[up].tag in ("article", "main")
            a_furniture[i] = a_furniture[up] or nodes[up].tag in ("nav", "aside", "footer", "header", "form")
        for x in v.parts:
            if isinstance(x, int):
                index[x] = kids[i]
                kids[i] += 1
            elif not skipped[i]:
                own[i] += len(x.strip())
                stops[i] += x.count(".") + x.count("!") + x.count("?") + x.count(",")
        if anchor[i]:
            linked[i] = own[i]
        links[i], para[i], li[i] = v.tag == "a", v.tag == "p", v.tag == "li"
        controls[i] = v.tag in ("input", "button", "select", "textarea", "label")
    text[:] = own
    length = own.copy()
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        for x in (text, linked, links, para, li, stops, controls):
            x[up] += x[i]
    for i, v in enumerate(nodes):
        siblings[i] = kids[v.parent] if v.parent >= 0 else 1
    total = max(text[0], 1.0)
    x = np.zeros((n, len(FAMILIES) + len(NUMBERS)))
    for i, v in enumerate(nodes):
        family = "heading" if v.tag in HEADINGS else "list" if v.tag in ("ul", "ol", "dl", "menu") else "table" if v.tag in ("table", "tr", "td", "th", "tbody") else v.tag
        x[i, FAMILIES.index(family) if family in FAMILIES else FAMILIES.index("div" if v.tag in BLOCK else "inline")] = 1
    x[:, len(FAMILIES) :] = np.stack(
        [
            good, bad, a_good, a_bad, a_content, a_furniture, [v.depth for v in nodes], np.minimum(index, 30), np.minimum(siblings, 30), np.log1p(text), np.log1p(length), text / total,
            linked / np.maximum(text, 1), np.log1p(links), np.log1p(para), text / np.maximum(para, 1) / 100, stops / np.maximum(text, 1) * 100, np.minimum(kids, 30), np.log1p(li), np.log1p(controls),
        ],
        axis=1,
    )
    return x


# --- training pages -------------------------------------------------------------------------------------------------


def training_page(seed: int) -> str:
    """A made-up page; elements of its main text carry the attribute data-gold, and so do their ancestors."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzäéíßñ"

    def word() -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(1, 10)))

    def sentence(a: int = 3, b: int = 25) -> str:
        return " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice([".", ".", ".", "!", "?", ","])

    def prose(a: int = 1, b: int = 9) -> str:
        return " ".join(sentence() for _ in range(r.randint(a, b)))

    def named(*names: str) -> str:
        return r.choice([f' class="{x}"' for x in names] + [f' id="{x}"' for x in names] + [f' class="x{r.randint(1, 9)} {names[0]}"'])

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{word() if r.random() < 0.7 else sentence(2, 6)}</a></{tag}>' for _ in range(k))

    menu = lambda: r.choice([f"<nav><ul>{links(r.randint(2, 9))}</ul></nav>", f"<div{named('menu', 'nav-bar', 'top-navigation')}>{links(r.randint(2, 8), 'span')}</div>", f"<ul{named('menu', 'breadcrumbs')}>{links(r.randint(2, 6))}</ul>"])
    header = lambda: r.choice([f"<header><h1>{sentence(1, 4)}</h1><p>{sentence()}</p></header>", f"<div{named('header', 'masthead', 'site-header')}><a href='/'>{word()}</a> {sentence(1, 5)}</div>", f"<header><a href='/'>{word()}</a></header>"])
    footer = lambda: r.choice([f"<footer>&copy; {word()}.example &middot; {prose(1, 3)}</footer>", f"<div{named('footer', 'site-footer', 'copyright')}><p>{prose(1, 3)}</p></div>", f"<footer><p>{prose(1, 2)}</p><ul>{links(4)}</ul></footer>"])
    advert = lambda: r.choice([f"<div{named('ad', 'advert', 'banner', 'ad-slot', 'sponsored')}>{prose(1, 4)}</div>", f"<div{named('promo', 'ads')}><p>{prose(1, 3)}</p><a href='/x'>{sentence(1, 3)}</a></div>", f"<aside{named('ad', 'promo-box')}><p>{prose(1, 3)}</p></aside>"])
    side = lambda: r.choice([f"<aside><h2>{sentence(1, 4)}</h2><ul>{links(r.randint(2, 8))}</ul><p>{prose(1, 3)}</p></aside>", f"<div{named('sidebar', 'side-bar', 'widget', 'related')}><h3>{sentence(1, 4)}</h3><p>{prose(1, 4)}</p><ul>{links(3)}</ul></div>"])
    notice = lambda: r.choice([f"<div{named('cookie-notice', 'notice', 'consent', 'gdpr-banner', 'alert')}><p>{prose(1, 3)}</p><button>{word()}</button></div>", f"<div{named('notice', 'popup', 'newsletter')} role=\"dialog\">{prose(1, 2)}</div>"])
    form = lambda: r.choice([f"<form><label>{sentence(1, 4)}</label><input name='q'><button>{word()}</button><p>{prose(1, 2)}</p></form>", f"<form{named('login', 'subscribe', 'search')}><p>{sentence()}</p><input><select><option>{word()}<option>{word()}</select></form>"])
    comments = lambda: r.choice([f"<section{named('comments', 'comment-list', 'responses comments')}><h2>{sentence(1, 3)}</h2>" + "".join(f"<div{named('comment', 'reply')}><p>{prose(1, 4)}</p></div>" for _ in range(r.randint(1, 6))) + "</section>", f"<ol{named('comments', 'commentlist')}>" + "".join(f"<li><b>{word()}</b><p>{prose(1, 4)}</p></li>" for _ in range(r.randint(1, 6))) + "</ol>"])
    share = lambda: f"<div{named('share', 'social', 'tags', 'meta')}>{links(r.randint(2, 5), 'span')}</div>"
    code = lambda: r.choice([f'<script>var t="</p>";{word()}({r.randint(1, 99)});</script>', f"<style>p{{margin:{r.randint(0, 9)}}}</style>", f"<!-- {sentence()} -->", "<noscript>x</noscript>"])
    g = ' data-gold="1"'

    def block() -> str:
        k = r.random()
        if k < 0.6:
            return f"<p{g}>{r.choice(['', '', f'<b{g}>', f'<i{g}>'])}{prose() if r.random() < 0.85 else sentence(1, 3)}{r.choice(['', '<br>'])}" + r.choice(["</p>", "</p>", ""])
        if k < 0.68:
            return f"<h{r.randint(2, 4)}{g}>{sentence(1, 7)}</h3>"
        if k < 0.74:
            return f"<ul{g}>" + "".join(f"<li{g}>{sentence()}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 6))) + "</ul>"
        if k < 0.79:
            return f"<blockquote{g}><p{g}>{prose(1, 3)}</p></blockquote>"
        if k < 0.83:
            return f"<p{g}>{sentence()} <a href='/{word()}'{g}>{sentence(1, 3)}</a> <em{g}>{sentence(1, 4)}</em> {prose(0, 2)}</p>"
        if k < 0.87:
            return f"<table{g}>" + "".join(f"<tr{g}><td{g}>{word()}</td><td{g}>{sentence(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if k < 0.91:
            return f"<div{g}>{prose()}</div>"
        if k < 0.94:
            return f"<pre{g}>{sentence()}\n  {sentence()}</pre>"
        return r.choice([advert, share, code, form, notice])() if r.random() < 0.7 else f"<p{g}>{word()}</p>"

    body = f"<h1{g}>{sentence(1, 9)}</h1>" * (r.random() < 0.9) + "".join(block() for _ in range(r.choice([1, 2, 3, 6, 12, 25])))
    if r.random() < 0.3:
        body += r.choice([comments, side, share])()
    shell = r.choice(["article", "article", "main", "div", "section", "plain"])
    if shell == "plain":
        main = body
    else:
        names = named("content", "post", "entry-content", "article-body", "story", "main") if shell in ("div", "section") or r.random() < 0.3 else ""
        main = f"<{shell}{names}{g}>{body}" + (f"</{shell}>" if r.random() < 0.95 else "")
    if r.random() < 0.4:
        main = f"<div{r.choice(['', named('wrapper', 'container', 'page')])}{g}>{r.choice(['', side()])}{main}{r.choice(['', side(), comments()])}</div>"
    before = [f() for f in (code, menu, header, menu, notice, advert, form, side, share) if r.random() < 0.4]
    after = [f() for f in (share, advert, comments, side, form, notice, menu, footer, footer, code) if r.random() < 0.35]
    r.shuffle(before)
    out = f'<!DOCTYPE html><html lang="{word()}"><head><title>{sentence()}</title>{code()}</head><body>{"".join(before)}{main}{"".join(after)}'
    return out + r.choice(["</body></html>", ""])


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seed in batch.column(0).to_pylist():
            nodes = parsed(training_page(seed))
            x = features(nodes)
            y = np.array([float("\0gold" in v.tokens) for v in nodes])
            y[0] = 1.0
            ok = np.array([v.tag not in HIDDEN and v.tag not in VOID for v in nodes])
            yield pa.RecordBatch.from_arrays([pa.array(x[ok].tolist(), pa.list_(pa.float64())), pa.array(y[ok])], ["x", "label"])


@dataclass
class Trees:
    """Boosted trees as arrays: per tree feature, threshold, left, right and value of each node."""

    trees: list
    weights: list

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for (feature, threshold, left, right, value), w in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += w * value[at]
        return 2 * total


def train(spark: SparkSession, pages: int = 500, trees: int = 20, depth: int = 5) -> Trees:
    """Trees trained on ``pages`` generated pages with Spark ML."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(0, pages, 1, 8).mapInArrow(_training, "x array<double>, label double")
    data = rows.select(array_to_vector("x").alias("features"), "label").cache()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5, maxBins=64).fit(data)
    data.unpersist()
    out = []
    for tree in model.trees:
        rows_: list[list[float]] = []

        def walk(node, rows_: list = rows_) -> int:  # noqa: ANN001
            at = len(rows_)
            rows_.append([-1, 0.0, 0, 0, node.prediction()])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows_[at][0], rows_[at][1] = split.featureIndex(), split.threshold()
                rows_[at][2] = walk(node.leftChild())
                rows_[at][3] = walk(node.rightChild())
            return at

        walk(tree._call_java("rootNode"))
        a = np.array(rows_)
        out.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return Trees(out, list(model.treeWeights))


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The best labelling in which content has content above it."""
    n = len(nodes)
    value = np.clip(odds, -6, 6).copy()
    hidden = np.array([v.tag in HIDDEN or v.tag in VOID for v in nodes])
    value[hidden] = 0.0
    drop, keep = -value, value.copy()
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        # a node that is dropped drops everything below it
        drop[up] += drop[i]
        keep[up] += max(keep[i], drop[i]) if not hidden[i] else drop[i]
    label = np.zeros(n, bool)
    label[0] = keep[0] >= drop[0] or bool((odds > 0).any())
    for i in range(1, n):
        label[i] = label[nodes[i].parent] and keep[i] > drop[i] and not hidden[i]
    return label


def blocks(nodes: list[Node], label: np.ndarray) -> list[str]:
    """Texts of the labelled nodes, by block, in page order."""
    out: list[str] = []
    buffer: list[str] = []

    def close() -> None:
        text = SPACE.sub(" ", "".join(buffer)).strip()
        if text:
            out.append(text)
        buffer.clear()

    stack: list = [(0, iter(nodes[0].parts))]
    while stack:
        i, parts = stack[-1]
        for x in parts:
            if not isinstance(x, int):
                if label[i]:
                    buffer.append(x)
                continue
            v = nodes[x]
            if v.tag == "br":
                buffer.append(" ")
                continue
            if v.tag in BLOCK:
                close()
            if label[x]:
                stack.append((x, iter(v.parts)))
                break
            if v.tag in BLOCK:
                close()
        else:
            if nodes[i].tag in BLOCK:
                close()
            stack.pop()
    close()
    return out


def main_text(page: str, trees: Trees) -> str:
    nodes = parsed(page)
    if len(nodes) == 1:
        return "\n\n".join(blocks(nodes, np.ones(1, bool)))
    return "\n\n".join(blocks(nodes, decode(nodes, trees.odds(features(nodes)))))


def extract(pages: DataFrame, trees: Trees, html_col: str = "html") -> DataFrame:
    """``pages`` with text (columns of that name are replaced): the main text, blocks joined by two newlines.

    Null and empty pages, and pages without main text, have an empty text; a page without any tag is its own text.
    Malformed markup is repaired, never an error. Equal pages get equal texts.
    """
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(trees)
    schema = struct_of(pages, T.StructField("text", T.StringType()))
    keep = schema.names[:-1]
    # columns go by place: their names may be those of the helpers
    fed = pages.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(f"`{html_col}`").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts: list[str] = []
            # features of many pages at once for the trees
            for i in range(0, len(column), 64):
                trees_of = [parsed(x or "") for x in column.slice(i, 64).to_pylist()]
                odds = shared.value.odds(np.concatenate([features(nodes) for nodes in trees_of]))
                at = 0
                for nodes in trees_of:
                    own = odds[at : at + len(nodes)]
                    at += len(nodes)
                    label = decode(nodes, own) if len(nodes) > 1 else np.ones(1, bool)
                    texts.append("\n\n".join(blocks(nodes, label)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return fed.mapInArrow(run, schema)
