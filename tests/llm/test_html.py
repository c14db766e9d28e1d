"""Main text: pages with missing ends, learnt weights, and the best stretch against all stretches."""

import random

import pytest

from pitlane.llm import html_text


def text_of(page, weights=None):
    return html_text.main_text(html_text.events(page), weights or {})


@pytest.mark.parametrize(("page", "want"), [
    ("<p>One two three four<p class='promo'>buy this thing<p>Later text of some words", "One two three four\nLater text of some words"),
    ("<p>One two three four</p><p class=share>share it</p><p>Later text of some words</p>", "One two three four\nLater text of some words"),
    ("<article><ul><li>first one<li class='ad'>buy<li>second one</ul><p>The rest of it</p></article>", "first one\nsecond one\nThe rest of it"),
    ("<p>Words before the picture</p><svg/><p>words after the picture</p>", "Words before the picture\nwords after the picture"),
    ("<p>Words <svg><text>not these</text></svg>around it</p>", "Words around it"),
    ("<article><p>Three words here</p><p class='social-history'>A social history of a town</p></article>",
     "Three words here\nA social history of a town"),
    ("<article><p>first<br>second<br/>third</p></article>", "first second third"),
    ("<div class='ad'>Buy it now and here<article><p>The text of it</p></article>", "The text of it"),
    ("<article><div class='ad'>Buy<p>The text of it, with no end of the advert</p></article>", "The text of it, with no end of the advert"),
    ("<main><h1>Title</h1><table><tr><td>a<td>b<tr><td>c</table></main><footer>end", "Title\na\nb\nc"),
    ("<article><p>The text of the page here</p></article><div id='comments'><article class='comment'>nice</article></div>",
     "The text of the page here"),
    ("<p></b>odd </i>ends</p></div>", "odd ends"), ("<nav>", ""), ("", ""), ("<", "<"),
])
def test_broken_pages(page, want):
    assert text_of(page) == want


def test_weights_decide():
    page = "<article><p>The text of the page here</p><div class='promo'>This is more of the same text</div></article>"
    assert text_of(page) == "The text of the page here"
    assert text_of(page, {".promo": 2.0}) == "The text of the page here\nThis is more of the same text"
    page = "<p>one two three x</p><div>four five six seven more</div><p>eight nine</p>"
    assert text_of(page) == "one two three x\nfour five six seven more"
    assert text_of(page, {"div": -9.0}) == "four five six seven more"
    assert text_of(page, {"div": -0.1, "/div": -0.1}) == "one two three x\nfour five six seven more\neight nine"


def test_best_stretch_against_all():
    rng = random.Random(3)
    names = ["p", "div", "li", "b", "/p", "/div", "/li", "/b"]
    for _ in range(300):
        page = "".join(f"<{rng.choice(names)}>" if rng.random() < 0.6 else "w " * rng.randint(1, 4) for _ in range(rng.randint(0, 14)))
        weights = {n: -rng.choice([0.5, 1.0, 2.0, 4.0]) for n in names} | {"": rng.choice([0.5, 1.0])}
        found = html_text.events(page)
        scores = [s for _, s in html_text.passed_over(found, weights)]
        best, stretch = 0.0, (0, 0)
        for last in range(1, len(scores) + 1):
            for first in reversed(range(last)):
                if (total := sum(scores[first:last])) > best:
                    best, stretch = total, (first, last)
        assert html_text.main_text(found, weights) == "\n".join(html_text.blocks(found[slice(*stretch)]))


def test_a_class_is_learnt(spark):
    """A class without a prior that never holds lines of documents is passed over, one of the prior that does is kept."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    pages, docs = [], []
    for i in range(20):
        lines = [" ".join(word() for _ in range(14)) for _ in range(4)]
        docs.append((i, "\n".join(lines)))
        odd = f"<div class='zug'>{' '.join(word() for _ in range(4))}</div>"
        pages.append((i, "u", f"<article><p>{lines[0]}</p>{odd}<p>{lines[1]}</p><p class='promo'>{lines[2]}</p><p>{lines[3]}</p>{odd}</article>"))
    pages += [pages[0], (None, None, None)]
    p, d = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string")
    weights = html_text.learn(p, d)
    assert weights[".zug"] < 0 < weights[".promo"]
    got = [(r["page_id"], r["text"]) for r in html_text.extract(p, d).collect()]
    assert sorted(got, key=str) == sorted([*docs, docs[0], (None, "")], key=str)
