import html.parser
import itertools
import os
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from cytoloom.llm import html_extract as he

SCHEMA = "page_id long, url string, html string, text string"


def test_held_out_pages():
    crf = he.model()
    wrong = total = 0
    for page, truth in he.labelled_pages(200, seed=77):
        found = he.blocks(page)
        assert [b.text for b in found] == [" ".join(t.split()) for t, _ in truth]
        wrong += sum(a != y for a, (_, y) in zip(crf.decode(found), truth, strict=True))
        total += len(truth)
    assert wrong <= 0.01 * total


def test_viterbi_is_the_best_of_all_labellings():
    crf = he.model()
    for page, _ in he.labelled_pages(60, seed=5):
        found = he.blocks(page)[:9]
        if not found:
            continue
        e = np.array([np.sum([crf.weights.get(f, (0, 0)) for f in he.path_features(b.path) + he.text_features(b.text, b.linked)], axis=0) for b in found])
        value = lambda ys: crf.starts[ys[0]] + crf.ends[ys[-1]] + sum(e[k, y] for k, y in enumerate(ys)) + sum(crf.moves[a, b] for a, b in zip(ys, ys[1:]))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(found)), key=value)
        assert np.isclose(value(best), value(crf.decode(found)))


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav>
<div class="cookie notice">We use cookies here.</div><!-- <p>no</p> --><article><h1>A  &amp; B</h1><p><b>First   para,
goes on here.<br><p>Second &lt;b&gt; caf&eacute; &#8212; done.</p><style>p{}</style></article>
<section class="comments"><p>Great post, thank you!</p></section><form><label>Mail</label></form><footer>&copy; us</footer>"""


def test_page():
    assert he.main_text(PAGE, he.model()) == "A & B\nFirst para, goes on here.\nSecond <b> café — done."


def test_odd_pages():
    for page in ("", "   ", "just text here, no tags at all.", "<", "<p", "<!--", "<script>x", "<p>a</div></p>b<br/>c", "&am &amp <b", '<a href="x>y</a>', "<p>" * 3000, "<div>" * 2000 + "x"):
        he.blocks(page)
    assert [b.text for b in he.blocks("<p>a<p>b<br>c<ul><li>d<li>e</ul>1 < 2 &am")] == ["a", "b c", "d", "e", "1 < 2 &am"]


def test_query(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = he.op9_html_extraction(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    want = he.main_text(PAGE, he.model())
    assert sorted(repr(tuple(r)) for r in out.collect()) == sorted(map(repr, [(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (None, "v", "", 0)]))
    assert he.extract(df).columns == ["page_id", "url", "text", "_text", "n_chars"]
    assert he.op9_html_extraction(df.limit(0)).collect() == []


def test_long_and_deep_pages_take_linear_time():
    crf = he.model()
    pages = ["<div>x" * 100_000, "<a " * 200_000, '<a href="x ' * 100_000, '<a ">"' * 80_000, "<div>" * 50_000 + "</q>" * 50_000, "<p><div>" + "<form>" * 30_000 + "<h1>a</h1>" * 30_000, "<script>" + "</script " * 100_000, "<!" * 100_000, "<!--" * 100_000]
    began = time.time()
    for page in pages:
        he.main_text(page, crf)
    assert time.time() - began < 30
    found = he.blocks(pages[0])
    assert len(found) == 100_000 and all(b.text == "x" for b in found)


class Reader(html.parser.HTMLParser):
    """Another reading of a page: texts between block-level tags, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.hidden = [], [], []
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        if text := " ".join("".join(self.now).split()):
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in he.RAW:
            self.hidden.append(tag)
        elif tag == "br":
            self.now.append(" ")
        elif tag not in he.INLINE:
            self.cut()

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
        elif tag not in he.INLINE and tag != "br":
            self.cut()

    def handle_data(self, data):
        if not self.hidden:
            self.now.append(data)


def test_blocks_are_those_of_another_parser():
    pages = [p for p, _ in he.labelled_pages(150, seed=9)]
    if os.path.isdir("/root/testdata/sf0.01"):
        pages += [p for p in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist() if p]
    for page in pages:
        assert [b.text for b in he.blocks(page)] == Reader(page).out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_articles_of_the_table_pages():
    """Pages whose article is marked as such in full: its blocks but for those of parts that the contract leaves out."""
    crf, checked = he.model(), 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        if not page or page.count("<article") != 1 or page.count("</article>") != 1:
            continue
        article = page[page.index("<article") : page.index("</article>")]
        if re.search(r"<(nav|aside|form|footer|header|section|div)\b", article):
            continue
        checked += 1
        assert he.main_text(page, crf) == "\n".join(Reader(article + "</article>").out)
    assert checked >= 20
