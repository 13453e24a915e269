"""Operator 5: main text of web pages by gradient-boosted trees over DOM nodes, with hierarchical decoding.

The trees are fitted by Spark ML on pages that a layout generator makes, where every node's label is known: menus,
headers, footers, sidebars, notices, adverts, forms, share bars and reader comments around articles of many shapes. The
fitted trees are small tables; pages are parsed and scored in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import random
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import dom
from waymark.llm.common import map_rows, shared_folder

#: Generated pages to learn from, trees, their depth and the step.
TRAIN_PAGES, TREES, DEPTH, STEP = 240, 24, 5, 0.25


class Layouts:
    """Pages of random layout whose main text is marked."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice("abcdefghiklmnoprstuvwz") for _ in range(r.randint(1, 10))) for _ in range(r.randint(low, high))]
        for k in range(len(out)):
            out[k] += r.choice(("", "", "", "", "", "", ",", ".", "."))
        return " ".join(out).capitalize() + r.choice((".", ".", ""))

    def named(self, *names: str) -> str:
        """class or id of one of the names, or none."""
        r = self.r
        if r.random() < 0.25:
            return ""
        name = r.choice(names) + r.choice(("", "", "-inner", "-box", " clearfix"))
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def links(self) -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(2, 12))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else " | ".join(items)

    def boilerplate(self, which: str) -> str:
        r = self.r
        if which == "menu":
            return r.choice((f"<nav>{self.links()}</nav>", f"<div{self.named('nav', 'menu', 'navbar', 'breadcrumb')}>{self.links()}</div>", f'<div class="menu">{self.links()}</div>'))
        if which == "header":
            return r.choice((f"<header><div>{self.words(1, 5)}</div>{self.links()}</header>", f'<div class="header"><h2>{self.words(1, 4)}</h2><p>{self.words(2, 9)}</p></div>', f"<header>{self.words(1, 8)}</header>"))
        if which == "footer":
            body = r.choice((f"&copy; {self.words(2, 12)}", f"<p>{self.words(3, 30)}</p>{self.links()}", f"{self.links()}<p>{self.words(2, 12)}</p>"))
            return r.choice((f"<footer>{body}</footer>", f"<footer>{body}</footer>", f'<div class="{r.choice(("footer", "copyright", "site-footer"))}">{body}</div>'))
        if which == "sidebar":
            body = f"<h3>{self.words(1, 4)}</h3>{self.links()}" + (f"<p>{self.words(5, 40)}</p>" if r.random() < 0.5 else "")
            return r.choice((f"<aside>{body}</aside>", f'<div class="{r.choice(("sidebar", "widget", "related", "recommended"))}">{body}</div>'))
        if which == "notice":
            return f'<div class="{r.choice(("cookie", "cookie-notice", "consent", "notice", "alert", "gdpr-popup", "banner"))}"><p>{self.words(5, 45)}</p>' + r.choice(("<button>OK</button>", "")) + "</div>"
        if which == "advert":
            body = r.choice((self.words(3, 30), f"<p>{self.words(3, 40)}</p>", f'<a href="/x">{self.words(2, 14)}</a>'))
            return f'<div class="{r.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo"))}">{body}</div>'
        if which == "form":
            return f'<form{self.named("search", "newsletter", "login", "subscribe")}><label>{self.words(1, 4)}</label><input name="q"><p>{self.words(2, 20)}</p><button>{self.words(1, 2)}</button></form>'
        if which == "share":
            return f'<div class="{r.choice(("share", "social", "sharing"))}">{self.links()}</div>'
        body = "".join(f'<{t}{self.named("comment", "reply")}><p>{self.words(1, 3)}</p><p>{self.words(5, 120)}</p></{t}>' for t in [r.choice(("div", "li", "article"))] * r.randint(1, 6))
        return r.choice((f'<section id="comments"><h3>{self.words(1, 3)}</h3>{body}</section>', f'<div class="{r.choice(("comments", "comment-list", "responses", "discussion"))}">{body}</div>', f'<ol class="commentlist">{body}</ol>'))

    def block(self) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.6:
            inner = self.words(r.choice((1, 2, 10, 20)), r.choice((30, 80, 200)))
            if r.random() < 0.3:
                inner = r.choice((f"<b>{inner}</b>", f"<b>{inner}<br>", f'{inner} <a href="/y">{self.words(1, 4)}</a> {self.words(2, 20)}', f"<em>{self.words(1, 4)}</em> {inner}<br>{self.words(3, 9)}"))
            return f"<p data-main=1>{inner}" + r.choice(("</p>", "</p>", "</p>", "\n"))
        if kind < 0.72:
            return f"<h{r.randint(1, 4)} data-main=1>{self.words(1, 10)}</h2>".replace("</h2>", "</h1></h2></h3></h4>")
        if kind < 0.82:
            return "<ul>" + "".join(f"<li data-main=1>{self.words(2, 25)}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote data-main=1>{self.words(5, 60)}</blockquote>"
        if kind < 0.93:
            return f"<figure><img src=x><figcaption data-main=1>{self.words(3, 15)}</figcaption></figure>"
        if kind < 0.97:
            return "<table>" + "".join(f"<tr><td data-main=1>{self.words(1, 5)}</td><td data-main=1>{self.words(1, 8)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<pre data-main=1>{self.words(4, 40)}</pre>"

    def page(self) -> str:
        r = self.r
        article = [f"<h1 data-main=1>{self.words(1, 12)}</h1>"] if r.random() < 0.85 else []
        article += [self.block() for _ in range(r.choice((1, 2, 3, 5, 8, 15, 30)))]
        for which in ("share", "advert", "comment", "form", "sidebar", "notice"):
            if r.random() < 0.15:
                article.insert(r.randint(0, len(article)), "</p>" + self.boilerplate(which))
        inner = "".join(article)
        shape = r.random()
        if shape < 0.45:
            inner = f"<article{self.named('post', 'entry', 'hentry')}>{inner}</article>"
        elif shape < 0.6:
            inner = f"<main{self.named('main', 'page')}>{inner}</main>"
        elif shape < 0.9:
            inner = f"<div{self.named('content', 'post', 'entry', 'article-body', 'story', 'text', 'main')}>{inner}</div>"
        for _ in range(r.choice((0, 0, 1, 2))):
            inner = f"<div{self.named('wrapper', 'container', 'page', 'row', 'column')}>{inner}</div>"
        before = [self.boilerplate(w) for w in ("header", "menu", "notice", "advert", "sidebar", "form") if r.random() < 0.4]
        after = [self.boilerplate(w) for w in ("comment", "sidebar", "advert", "share", "menu", "form", "footer", "notice") if r.random() < 0.35]
        r.shuffle(before)
        body = "".join(before) + inner + "".join(after)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title><style>p{{}}</style><script>x()</script></head><body>{body}" + r.choice(("</body></html>", ""))


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a generated page's nodes: 1 if main text is there or below."""
    nodes = dom.parse(page)
    label = np.array([x.main for x in nodes])
    for k in range(len(nodes) - 1, 0, -1):
        label[nodes[k].parent] |= label[k]
    return dom.features(nodes), label


class Trees:
    """Fitted trees as tables: for each tree its weight, and by node the feature, threshold, children and prediction."""

    def __init__(self, trees: list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.trees = trees

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for weight, feature, threshold, left, right, prediction in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                goes_left = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(f < 0, at, np.where(goes_left, left[at], right[at]))
            out += weight * prediction[at]
        return 2 * out


@cache
def _generated(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    made = Layouts(seed)
    parts = [labelled(made.page()) for _ in range(pages)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])


_fitted: dict[tuple, Trees] = {}


def fit(spark: SparkSession, pages: int = TRAIN_PAGES, seed: int = 11) -> Trees:
    """Trees fitted on generated pages, whose number bounds the sample; the same parameters give the same trees."""
    if (pages, seed) in _fitted:
        return _fitted[pages, seed]
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    x, y = _generated(pages, seed)
    table = pa.table({"x": pa.array(list(x)), "label": pa.array(y.astype(float))})
    rows = spark.createDataFrame(table).select(array_to_vector("x").alias("features"), "label").coalesce(2)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=seed).fit(rows)
    folder = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(folder)
    data = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").select("treeID", "id", "prediction", "leftChild", "rightChild", "split.featureIndex", F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold")).collect()
    trees = []
    for k, weight in enumerate(model.treeWeights):
        own = sorted((r for r in data if r["treeID"] == k), key=lambda r: r["id"])
        leaf = [r["leftChild"] < 0 for r in own]
        trees.append((
            float(weight), np.array([-1 if e else r["featureIndex"] for r, e in zip(own, leaf, strict=True)]), np.array([0.0 if e else r["threshold"] for r, e in zip(own, leaf, strict=True)]),
            np.array([max(0, r["leftChild"]) for r in own]), np.array([max(0, r["rightChild"]) for r in own]), np.array([r["prediction"] for r in own]),
        ))
    _fitted[pages, seed] = Trees(trees)
    return _fitted[pages, seed]


def main_text(pages: list[str], trees: Trees) -> list[str]:
    """The main text of each page; the nodes of all pages are scored together."""
    parsed = [dom.parse(p) for p in pages]
    at = np.concatenate(([0], np.cumsum([len(n) for n in parsed])))
    logits = trees.logits(np.concatenate([dom.features(n) for n in parsed])) if pages else np.zeros(0)
    return [dom.text_of(n, dom.decode(n, logits[a:b])) for n, a, b in zip(parsed, at, at[1:], strict=False)]


TEXT = "page_id long, url string, text string, n_chars long"
#: Pages that are parsed and scored together.
PAGES_AT_ONCE = 32


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole html. No shuffle.

    A row for each row of pages; a null or empty html has an empty text.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)  # TREES tables of at most 2**DEPTH leaves

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [p or "" for p in batch.column(2).to_pylist()]
        texts = [t for i in range(0, len(raw), PAGES_AT_ONCE) for t in main_text(raw[i : i + PAGES_AT_ONCE], shared.value)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [f.split()[0] for f in TEXT.split(", ")])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_rows(rows, work, TEXT)
