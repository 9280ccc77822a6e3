"""Main text of pages: the field against brute force, held-out layouts, the given pages, odd markup."""

import html
import itertools
import os
import re
import time

import numpy as np
import pytest

from loomwright.llm import pages
from loomwright.llm.layouts import MAIN, labelled_pages

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def model():
    return pages.train(labelled_pages(pages.TRAINING_PAGES, pages.SEED))


def score(model, blocks, labels):
    """The score of one labeling of a page, term by term."""
    alone = model.scores(blocks)
    total = model.first[labels[0]] + sum(s for s, label in zip(alone, labels) if label)
    for n in range(1, len(blocks)):
        total += model.steps[int(blocks[n].parent == blocks[n - 1].parent)][labels[n - 1]][labels[n]]
    return total


def test_viterbi_finds_the_best_labeling(model):
    done = 0
    for page in labelled_pages(60, 5):
        blocks = pages.leaf_blocks(page.replace(MAIN, ""))[:11]
        every = list(itertools.product((0, 1), repeat=len(blocks)))
        best = max(score(model, blocks, labels) for labels in every)
        assert score(model, blocks, model.decode(blocks)) == pytest.approx(best)
        done += len(blocks) > 5
    assert done > 20 and model.decode([]) == []


def test_chances_are_those_of_all_labelings():
    rng = np.random.default_rng(7)
    emit, steps, first = rng.normal(size=(3, 5)), rng.normal(size=(2, 2, 2)), rng.normal(size=2)
    mask = np.arange(5) < np.array([[5], [3], [1]])
    same = rng.integers(0, 2, (3, 5))
    whole, chance, pair = pages._likelihood(np.where(mask, emit, 0), same, mask, steps, first)
    for p, length in enumerate(mask.sum(axis=1)):
        sums, total = np.zeros((5, 2)), 0
        for labels in itertools.product((0, 1), repeat=int(length)):
            s = first[labels[0]] + sum(emit[p, t] * x for t, x in enumerate(labels))
            s += sum(steps[same[p, t], labels[t - 1], labels[t]] for t in range(1, length))
            total += np.exp(s)
            for t, x in enumerate(labels):
                sums[t, x] += np.exp(s)
        assert whole[p] == pytest.approx(np.log(total)) and np.allclose(chance[p, :length], sums[:length] / total)
    assert np.allclose(pair[0].sum(axis=(1, 2)), 1) and pair[2].sum() == 0


def test_held_out_layouts(model):
    right = found = true = exact = 0
    held_out = labelled_pages(300, 2_024)
    for page in held_out:
        want = [b.text.startswith(MAIN) for b in pages.leaf_blocks(page)]
        got = model.decode(pages.leaf_blocks(page.replace(MAIN, "")))
        right += sum(x and y for x, y in zip(want, got))
        found, true, exact = found + sum(got), true + sum(want), exact + (got == [int(x) for x in want])
    assert right / found > 0.985 and right / true > 0.985 and exact / len(held_out) > 0.88


def plain_article(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:h1|p)>", inner))
    return " ".join(b for b in blocks if b)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_given_pages(spark, model):
    """Here the article is marked as such, so that it can be cut out by plain text search."""
    table = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    want = {(r.page_id, r.url, text, len(text)) for r in table.collect() for text in [plain_article(r.html)]}
    assert {tuple(r) for r in pages.extract(table, model).collect()} == want


PARTS = {
    "<aside><h3>Most read</h3><p>Another story about the river.</p></aside>": False,
    '<section class="comments"><h3>3 comments</h3><p>I do not agree with this story at all.</p></section>': False,
    '<ol id="comment-list"><li>Well said, thank you for it.</li><li>No, never.</li></ol>': False,
    "<form><label>E-mail</label><input><button>Send</button></form>": False,
    '<div class="advertisement"><p>Buy the new stone now, half the price.</p></div>': False,
    '<div class="cookie-notice">We use cookies. <a href="#">Accept</a></div>': False,
    "<script>document.write('<p>never shown</p>')</script><style>p > b {color: red}</style>": False,
    "<!-- <p>not shown either</p> -->": False,
    "<p>A paragraph of the story itself, with a comma &amp; an end.</p>": True,
    "<blockquote><p>Somebody said this about the seven houses by the river.</p></blockquote>": True,
    "<h2>What came next</h2>": True,
}


@pytest.mark.parametrize("shell", ["<article>{}</article>", '<main><div class="post-body">{}</div></main>', '<div id="content">{}</div>'])
def test_parts_of_a_page(model, shell):
    text = "<p>The river walked past the seven houses, and nobody had ever seen it so blue before that morning.</p>"
    inner = f"<h1>The blue river</h1>{text}{''.join(PARTS)}{text}"
    page = f'<html><head><title>T</title></head><body><header><p>The Daily Stone</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>{shell.format(inner)}<footer>&copy; 2024</footer>'
    got = pages.main_text(page, model)
    for part, main in PARTS.items():
        words = html.unescape(re.sub("<[^>]*>", " ", part)).split()
        assert (" ".join(words) in got) == main, part
    assert got.startswith("The blue river The river walked") and "Home" not in got and "Daily" not in got and "2024" not in got


def texts(page):
    return [b.text for b in pages.leaf_blocks(page)]


def test_blocks_of_odd_markup():
    assert texts("") == texts("<p></p> <div>\n</div>") == texts("<!doctype html>") == texts("<script>x<p>y") == []
    assert texts("one<p>two <b>and</b>\n three<p>four<br>five<li>six<li>seven</ul>eight") == ["one", "two and three", "four five", "six", "seven", "eight"]
    assert texts("<p>a < b &amp;&lt;p&gt; &#228;&#x1F600;&nbsp;&copy &bogus; 3<4") == ["a < b &<p> ä😀 © &bogus; 3<4"]
    assert texts('<p title="a > b">x</p><P CLASS=y/>z<!-- <p>no --><!-->w') == ["x", "zw"]
    assert texts('<div a="unclosed>q</div><p>rest') == ["q", "rest"] and texts("<p>end<") == ["end<"] and texts("<p>x<b") == ["x"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table><style>p{}</STYLE >tail</b></i></div>") == ["1", "2", "3", "tail"]
    assert texts("<head><title>t</title><p>in a broken head</p></body>") == ["in a broken head"]


def test_long_and_deep_pages_take_linear_time(model):
    start = time.time()
    assert len(pages.main_text("<article>" + "<p>word, " * 100_000 + "</article>", model)) == 100_000 * 6 - 1
    assert pages.main_text("<article>" + "<div><b>" * 50_000 + "deep inside" + "</b></div>" * 50_000, model) in ("", "deep inside")
    assert len(pages.main_text("<article><p>" + "long text of one block, " * 200_000, model)) == 24 * 200_000 - 1
    assert texts("<a '" * 20_000) is not None and texts("<!--" * 50_000) == [] and len(texts("&" * 100_000 + "<" * 100_000)) == 1
    assert time.time() - start < 60


def test_table_cases(spark, model):
    schema = "page_id long, url string, html string, text string, n_chars string"
    page = "<article><h1>Title here</h1><p>Some text of the article, long enough to be read.</p></article>"
    data = [(1, "u", page, "own", "own"), (1, "u", page, "own", "own"), (None, None, None, None, None), (2, None, "", "", ""), (3, "u", "<nav>menu</nav>", "", "")]
    got = sorted((tuple(r) for r in pages.extract(spark.createDataFrame(data, schema), model).collect()), key=str)
    text = "Title here Some text of the article, long enough to be read."
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, None, "", 0), (3, "u", "", 0)], key=str)
    assert pages.extract(spark.createDataFrame([], schema), model).collect() == []
