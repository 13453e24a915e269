"""Operator 5 on written pages whose article is known, and the tree and the decoding on their own."""

from __future__ import annotations

import time

import numpy as np
import pytest

from waymark.llm import dom, html_text

SENTENCES = [
    "The harbour was quiet when the first boats came in, and nobody spoke for a while.",
    "Later that morning a letter arrived, carried by a boy who had walked from the next village.",
    "It said little, but what it said was enough to change everything about the winter ahead.",
    "They read it twice, folded it carefully, and put it back into the drawer with the others.",
]


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>A title</title><style>p {{ }}</style><script>var a = '<p>no</p>';</script></head><body>{body}</body></html>"


MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">About</a></li><li><a href="/c">Contact us</a></li></ul></nav>'
FOOTER = "<footer><p>&copy; 2024 Some Company. All rights reserved.</p></footer>"
SIDE = '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">One story</a></li><li><a href="/2">Another story</a></li></ul></aside>'
COMMENTS = '<section id="comments"><div class="comment"><p>Nice post, thank you very much for this one.</p></div></section>'
PARAGRAPHS = "".join(f"<p>{s}</p>" for s in SENTENCES)
ARTICLE = "\n\n".join(["The heading", *SENTENCES])

CASES = {
    "article": (page(f"{MENU}<article><h1>The heading</h1>{PARAGRAPHS}</article>{SIDE}{COMMENTS}{FOOTER}"), ARTICLE),
    "div": (page(f'<header><div>Site name</div>{MENU}</header><div class="content"><h1>The heading</h1>{PARAGRAPHS}</div>{FOOTER}'), ARTICLE),
    "notice": (page(f'<div class="cookie-notice"><p>We use cookies to improve your visit.</p><button>OK</button></div><main><h1>The heading</h1>{PARAGRAPHS}</main>{FOOTER}'), ARTICLE),
    "references": (page(f"{MENU}<article><p>Caf&eacute; &amp; bar &#8212; it&#x27;s   open,\n and has been for   thirty years, as everyone here knows well.</p>{PARAGRAPHS}</article>"), "\n\n".join(["Café & bar — it's open, and has been for thirty years, as everyone here knows well.", *SENTENCES])),
}


@pytest.fixture(scope="module")
def trees(spark):
    return html_text.fit(spark)


def test_written_pages(spark, trees):
    rows = [(k, f"http://x/{name}", html, "t", 1) for k, (name, (html, _)) in enumerate(CASES.items())]
    found = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long"), trees).collect()}
    for k, (name, (_, want)) in enumerate(CASES.items()):
        assert found[k]["text"] == want, name
        assert found[k]["n_chars"] == len(want) and found[k]["url"] == f"http://x/{name}"


def test_odd_pages(spark, trees):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<"), (4, None, "<<<>>></p></div><p"), (5, "u", "<div>" * 3000 + "x"), (None, "u", CASES["article"][0]), (6, "u", CASES["article"][0]), (6, "u", CASES["article"][0]), (7, "u", page(f"<article>{PARAGRAPHS * 2000}</article>"))]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), trees).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    by = {str(r["page_id"]): r["text"] for r in found}
    assert by["1"] == by["2"] == "" and by["None"] == by["6"] == ARTICLE and by["7"].count(SENTENCES[1]) == 2000
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string"), trees).collect() == []


def test_generated_pages_that_nothing_was_learned_from(trees):
    made = html_text.Layouts(99)
    right = total = 0
    for _ in range(60):
        x, y = html_text.labelled(made.page())
        right += int(((trees.logits(x) > 0) == y).sum())
        total += len(y)
    assert right / total > 0.95


def test_tree():
    nodes = dom.parse("<body><p>one<p>two <b>bold</b><ul><li>a<li>b</ul>after<script>no</script><br>end")
    assert [n.tag for n in nodes] == ["html", "body", "p", "p", "ul", "li", "li"]
    assert dom.text_of(nodes, np.ones(len(nodes), bool)) == "one\n\ntwo bold\n\na\n\nb\n\nafter end"


def test_decoding_never_contradicts_itself():
    r = np.random.default_rng(3)
    for _ in range(50):
        n = int(r.integers(1, 9))
        nodes = [dom.Node("div", parent=-1 if k == 0 else int(r.integers(0, k))) for k in range(n)]
        logits = r.normal(size=n)
        kept = dom.decode(nodes, logits)
        best = max(sum(logits[k] for k in range(n) if m >> k & 1) for m in range(1 << n) if all(not m >> k & 1 or k == 0 or m >> nodes[k].parent & 1 for k in range(n)))
        assert all(not kept[k] or k == 0 or kept[nodes[k].parent] for k in range(n))
        assert logits[kept].sum() == pytest.approx(best)


def test_head_without_its_end():
    every = lambda page: dom.text_of(nodes := dom.parse(page), np.ones(len(nodes), bool))
    for start in ("<html><head><title>x</title><body>", "<head><meta charset=utf-8><title>x</title>", "<head><title>x</title><template><div>no</div></template>"):
        assert every(f"{start}<p>one<p>two") == "one\n\ntwo"
    assert every("<head><title>x</title> plain <b>text</b>") == "plain text"
    assert every("<body><p>a<select><option>no<div>one</div><p>two") == "a\n\none\n\ntwo"
    assert every("<body><p>a<select><option>no<option>no</select> b<p>two") == "a b\n\ntwo"


def test_time_is_in_proportion_to_a_page_whatever_is_in_it():
    for junk in ("<a ", '<a "', "<a '>", "<!", "<!--", "<title>", "<p>", "<", "<script", "<b><hr>", "</i>"):
        began = time.perf_counter()
        dom.parse("<b>" * 20_000 + junk * (200_000 // len(junk)) + "</b>" * 20_000)
        assert time.perf_counter() - began < 10
    assert len(dom.parse("<i><div>" + "<b>" * 60_000 + "</i>" * 60_000)) == 2


def test_quotes_in_tags():
    text = lambda page: [t for n in dom.parse(page) for _, t in n.runs]
    assert text('<p title="a > b">one</p><p>two</p>') == ["one", "two"]
    assert text("<p title='never closed>one</p><p>two</p>") == ["one", "two"]
    assert text("<p>three <a href=x") == ["three <a href=x"]
