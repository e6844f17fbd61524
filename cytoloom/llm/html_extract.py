"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text without a block-level tag between them. Each block has binary
features of its ancestors (tags, words of class and id) and of its text (length, link share, signs), and is labelled
main or other by Viterbi. Weights maximise the conditional likelihood of labelled pages (forward-backward, L2 penalty,
Adam); the labelled pages are built by ``labelled_pages`` from layouts with known parts, PAGES of them, and training
takes some seconds on the driver. The model is a small dictionary that travels with the task.

Character references are decoded, white space in a block becomes one space, blocks are joined by a line feed. Scripts,
styles, comments and what is in the head never form blocks.

Reading takes time and memory in proportion to a page, whatever its nesting, open quotes and unclosed tags: blocks share
their ancestors, which know what they add to the scores, and the search for the ends of tags never starts twice from
one place.

Nulls: a null html is the empty page, with empty text. Long pages are read whole. Repeated rows come out as often as
they come in; extra columns pass through ``extract``, whose text and n_chars get underscores where they clash. An empty
table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ready
from .common import fresh

PAGES, EPOCHS, RATE, PENALTY = 300, 80, 0.1, 2e-4
MAIN, OTHER = 1, 0

#: Elements of HTML.
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript iframe object svg canvas textarea title select".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: What ends the search for an open element of the same kind, and the kinds that are searched for.
BARRIERS = set("div ul ol table article section body".split())
SIBLINGS = {"li": {"p", "li"}, "tr": {"p", "tr"}, "td": {"p", "td"}, "th": {"p", "th"}, "option": {"p", "option"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}}
CLOSED_BY_OTHERS = {"p", "li", "tr", "td", "th", "option", "dt", "dd"}

TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Node:
    """An open element: its tag, what it is nested in, and the features that it brings which no ancestor has."""

    __slots__ = ("above", "added", "depth", "in_body", "in_head", "places", "scores", "tag", "words")

    def __init__(self, tag: str, words: tuple[str, ...], above: Node | None, depth: int, added: tuple[str, ...]):
        self.tag, self.words, self.above, self.depth, self.added = tag, words, above, depth, added
        self.in_head = tag == "head" or above is not None and above.in_head
        self.in_body = tag == "body" or above is not None and above.in_body
        # (tag, depth) of the open elements up to the next barrier that others may close, one for each tag
        around = () if above is None or tag in BARRIERS else above.places
        self.places = (*(x for x in around if x[0] != tag), (tag, depth)) if tag in CLOSED_BY_OTHERS else around
        self.scores: tuple[float, float] | None = None  # of the features of the whole path


@dataclass
class Block:
    path: Node | None  # the innermost ancestor
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class Ends:
    """Finds where tags end in one page. Asked for rising places, it looks at no stretch of the page twice."""

    def __init__(self, page: str):
        self.page = page
        self.angle_at = self.sign_at = -1
        self.sign = re.compile("[>\"']")
        self.known: dict[int, int] = {}  # place of an opening quote -> the end of its tag, -1 for none

    def angle(self, at: int) -> int:
        """The first > from ``at`` on, or -1."""
        if self.angle_at < at and self.angle_at != len(self.page):
            found = self.page.find(">", at)
            self.angle_at = len(self.page) if found < 0 else found
        return -1 if self.angle_at == len(self.page) else self.angle_at

    def outside(self, at: int) -> int:
        """The first > from ``at`` on that stands outside quotes, or -1."""
        if self.sign_at < at:
            found = self.sign.search(self.page, at)
            self.sign_at = found.start() if found else len(self.page)
        here, walked = self.sign_at, []
        while True:
            if here >= len(self.page):
                end = -1
                break
            if self.page[here] == ">":
                end = here
                break
            if here in self.known:
                end = self.known[here]
                break
            walked.append(here)
            shut = self.page.find(self.page[here], here + 1)
            found = self.sign.search(self.page, shut + 1) if shut >= 0 else None
            here = found.start() if found else len(self.page)
        self.known.update(dict.fromkeys(walked, end))
        return end


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of the tags, comments and declarations of a page (the latter two without a
    name). The caller may send a place from which to go on. A < that begins none of them is text."""
    ends, at = Ends(page), 0
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            shut = page.find("-->", start + 4)
            end = len(page) if shut < 0 else shut + 3
            found = (start, end, "", False, "")
        else:
            shut = ends.angle(start)
            if shut < 0:  # only a comment without end may follow
                at = page.find("<!--", at)
                if at < 0:
                    return
                continue
            closing = page.startswith("/", at)
            if page[at : at + 1] in ("!", "?"):
                found = (start, shut + 1, "", False, "")
            elif name := TAG_NAME.match(page, at + closing):
                end = ends.outside(name.end())
                # with an odd quote the tag ends at the next >
                end = end if end >= 0 else ends.angle(name.end())
                found = (start, end + 1, name[0].lower(), closing, page[name.end() : end])
            else:
                continue
        go_on = yield found
        at = found[1]
        if go_on is not None:
            at = go_on
            yield found  # what send() returns; the next one follows


@lru_cache(maxsize=20_000)
def _words(names: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"[a-z]+", names)))


def words_of(attributes: str) -> tuple[str, ...]:
    """The distinct words of class, id and role."""
    if "=" not in attributes:
        return ()
    names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower()
    return _words(names) if len(names) < 200 else _words.__wrapped__(names)


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[Node] = []
    open_tags: Counter[str] = Counter()
    active: Counter[str] = Counter()  # features of the open elements
    now: Block | None = None
    links = at = 0

    def add(text: str) -> None:
        nonlocal now
        if now is None:
            if text.isspace():
                return
            now = Block(stack[-1] if stack else None)
        now.parts.append(text)
        if links:
            now.linked += len(text)

    def end() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join("".join(now.parts).split())
            now.parts = []
            if now.text and (now.path is None or not now.path.in_head or now.path.in_body):
                out.append(now)
        now = None

    def push(tag: str, words: tuple[str, ...]) -> None:
        found = (f"in:{tag}", *(f"word:{w}" for w in words))
        stack.append(Node(tag, words, stack[-1] if stack else None, len(stack), tuple(f for f in found if not active[f])))
        open_tags[tag] += 1
        active.update(found)

    def cut(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            open_tags[node.tag] -= 1
            for f in (f"in:{node.tag}", *(f"word:{w}" for w in node.words)):
                active[f] -= 1
                if not active[f]:
                    del active[f]

    found_tags = tags(page)
    for start, stop, tag, closing, rest in found_tags:
        if start > at:
            text = page[at:start]
            add(html.unescape(text) if "&" in text else text)
        at = stop
        if not tag:
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            end()
            if open_tags[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                cut(depth)
            continue
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            shut = page.find(">", over.end()) if over else -1
            at = shut + 1 if shut >= 0 else len(page)
            found_tags.send(at)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        end()
        links = 0
        if stack and (tag in CLOSES_P or tag in SIBLINGS):
            closes = SIBLINGS.get(tag, {"p"})
            cut(max((depth for t, depth in stack[-1].places if t in closes), default=len(stack)))
        if tag not in VOID and not rest.endswith("/"):
            push(tag, words_of(rest))
    if at < len(page):
        text = page[at:]
        add(html.unescape(text) if "&" in text else text)
    end()
    return out


def path_features(path: Node | None) -> list[str]:
    found = {f"leaf:{path.tag}"} if path else set()
    while path:
        found |= set(path.added)
        path = path.above
    return sorted(found)


def text_features(text: str, linked: int) -> list[str]:
    n = len(text)
    out = [f"size:{min(n.bit_length(), 10)}", f"links:{min(4, 4 * linked // n)}"]
    if text[-1] in ".!?:;\"')":
        out.append("ends")
    if "©" in text:
        out.append("copyright")
    if "," in text:
        out.append("comma")
    return out


# --- labelled pages -------------------------------------------------------------------------------------------------

SYLLABLES = "ba ne ri to lu sha ver mon tik pel dar ous ing ent al é ü ñ".split()


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(text, label) of every block]) of ``n`` pages in varied layouts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randrange(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    sentence = lambda: words(4, 18).capitalize() + rng.choice([".", ".", ".", "!", "?", ", " + words(2, 8) + "."])

    def page() -> tuple[str, list[tuple[str, int]]]:
        out: list[str] = []
        truth: list[tuple[str, int]] = []

        def block(markup: str, text: str, label: int) -> None:
            out.append(markup.replace("{}", html.escape(text)))
            truth.append((text, label))

        def listed(tag: str, attribute: str = "") -> None:
            out.append(f"<{tag}{attribute}><ul>")
            for _ in range(rng.randrange(2, 7)):
                block(f'<li><a href="/{word()}">{{}}</a></li>', words(1, 4), OTHER)
            out.append(f"</ul></{tag}>")

        def boxed(tag: str, attribute: str, times: int = 1) -> None:
            out.append(f"<{tag}{attribute}>")
            for _ in range(times):
                inner = rng.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<p><b>{}</b></p>"]) if times == 1 else "<p>{}</p>"
                block(inner, rng.choice([sentence(), words(2, 9), sentence() + " " + sentence()]), OTHER)
            out.append(f"</{tag}>")

        def named(*names: str) -> str:
            return f' {rng.choice(["class", "id"])}="{rng.choice(["", "site-", "page "])}{rng.choice(names)}"'

        def other(place: str) -> None:
            kind = rng.choice(["menu", "ad", "notice", "form", "share", "side", "related", "crumbs"])
            if kind == "menu":
                listed(*rng.choice([("nav", ""), ("div", named("menu", "nav", "navbar", "navigation"))]))
            elif kind == "ad":
                boxed("div", named("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo"))
            elif kind == "notice":
                boxed("div", named("cookie", "cookie notice", "notice", "consent", "popup", "alert", "newsletter"))
            elif kind == "form":
                out.append(f"<form{named('search', 'login', 'subscribe')}>")
                block("<label>{}</label><input type='text'>", words(1, 4), OTHER)
                block("<p>{}</p>", sentence(), OTHER)
                block("<button>{}</button></form>", words(1, 3), OTHER)
            elif kind == "share":
                listed("div", named("share", "social", "tags"))
            elif kind == "side":
                boxed(*rng.choice([("aside", ""), ("div", named("sidebar", "aside", "widget"))]), times=rng.randrange(1, 4))
            elif kind == "related":
                listed(*rng.choice([("div", named("related", "recommended", "more")), ("section", named("related"))]))
            else:
                listed("div", named("breadcrumb", "breadcrumbs"))

        def comments() -> None:
            tag = rng.choice(["section", "div"])
            out.append(f"<{tag}{named('comments', 'comment-list', 'discussion', 'replies')}>")
            if rng.random() < 0.6:
                block("<h3>{}</h3>", words(1, 3), OTHER)
            for _ in range(rng.randrange(1, 5)):
                block(rng.choice(["<div class='comment'><p>{}</p></div>", "<p>{}</p>", "<ol><li>{}</li></ol>", "<article class='comment'><p>{}</p></article>"]), sentence() + " " + sentence(), OTHER)
            out.append(f"</{tag}>")

        def article() -> None:
            tag, attribute = rng.choice([("article", ""), ("article", ' class="post"'), ("main", ""), ("div", named("content", "article", "post", "entry", "story", "main")), ("article", "")])
            out.append(f"<{tag}{attribute}>")
            if rng.random() < 0.8:
                block(rng.choice(["<h1>{}</h1>", "<h1 class='title'>{}</h1>", "<h2>{}</h2>"]), words(2, 10).capitalize() + rng.choice(["", "."]), MAIN)
            for _ in range(rng.choice([1, 2, 4, 8, 14])):
                shape = rng.random()
                text = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 9])))
                if shape < 0.7:
                    block(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{}</p>\n", "<div>{}</div>"]), text if rng.random() < 0.9 else words(1, 4), MAIN)
                elif shape < 0.78:
                    block("<blockquote>{}</blockquote>", text, MAIN)
                elif shape < 0.86:
                    out.append("<ul>")
                    for _ in range(rng.randrange(1, 5)):
                        block("<li>{}</li>", rng.choice([sentence(), words(1, 5)]), MAIN)
                    out.append("</ul>")
                elif shape < 0.93:
                    block("<h2>{}</h2>", words(1, 6), MAIN)
                elif shape < 0.95:
                    block("<pre>{}</pre>", words(3, 9), MAIN)
                elif rng.random() < 0.8:
                    other("in")
            if rng.random() < 0.2:
                comments()
            out.append(f"</{tag}>")

        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>")
        wrap = rng.random() < 0.3
        out.append("<div id='page'>" if wrap else "")
        if rng.random() < 0.5:
            boxed(*rng.choice([("header", ""), ("div", named("header", "masthead", "top"))]))
        for _ in range(rng.randrange(0, 4)):
            other("before")
        article()
        if rng.random() < 0.35:
            comments()
        for _ in range(rng.randrange(0, 3)):
            other("after")
        if rng.random() < 0.85:
            boxed(*rng.choice([("footer", ""), ("div", named("footer", "copyright", "legal"))]))
            if rng.random() < 0.5:
                out[-2] = out[-2].replace(html.escape(truth[-1][0]), "&copy; " + html.escape(truth[-1][0]))
                truth[-1] = ("© " + truth[-1][0], OTHER)
        out.append("</div>" if wrap else "")
        out.append("</body></html>" if rng.random() < 0.9 else "")
        return "".join(out), truth

    return [page() for _ in range(n)]


# --- the model ------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Scores: weights[feature] = (other, main); moves[a, b] from label a to b; starts and ends of the chain."""

    weights: dict[str, tuple[float, float]]
    moves: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def of_path(self, path: Node | None) -> tuple[float, float]:
        """Scores of the features of a path, kept at its elements."""
        todo = []
        node = path
        while node is not None and node.scores is None:
            todo.append(node)
            node = node.above
        get = self.weights.get
        for node in reversed(todo):
            x, y = node.above.scores if node.above is not None else (0.0, 0.0)
            for f in node.added:
                if w := get(f):
                    x, y = x + w[0], y + w[1]
            node.scores = (x, y)
        if path is None:
            return 0.0, 0.0
        leaf = get(f"leaf:{path.tag}", (0.0, 0.0))
        return path.scores[0] + leaf[0], path.scores[1] + leaf[1]

    def decode(self, found: list[Block]) -> list[int]:
        """Viterbi labels of the blocks of one page."""
        if not found:
            return []
        get = self.weights.get
        (m00, m01), (m10, m11) = self.moves.tolist()
        back: list[tuple[int, int]] = []
        a, b = self.starts.tolist()
        for k, block in enumerate(found):
            x, y = self.of_path(block.path)
            for f in text_features(block.text, block.linked):
                if w := get(f):
                    x, y = x + w[0], y + w[1]
            if k:
                to_a, to_b = (a + m00, b + m10), (a + m01, b + m11)
                back.append((int(to_a[1] > to_a[0]), int(to_b[1] > to_b[0])))
                a, b = max(to_a), max(to_b)
            a, b = a + x, b + y
        label = int(b + self.ends[1] > a + self.ends[0])
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS) -> Field:
    """Fits a field to (features of each block, labels) of pages by maximum conditional likelihood."""
    pages = [p for p in pages if p[1]]
    index = {f: k for k, f in enumerate(sorted({f for xs, _ in pages for x in xs for f in x}))}
    design = np.zeros((sum(len(ys) for _, ys in pages), len(index)))  # a row for each block
    for row, x in zip(design, (x for xs, _ in pages for x in xs), strict=True):
        row[[index[f] for f in x]] = 1
    labels = np.array([y for _, ys in pages for y in ys])
    cuts = np.cumsum([0, *(len(ys) for _, ys in pages)]).tolist()
    theta = np.zeros(2 * len(index) + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        w, moves, starts, ends = _split(theta)
        grad = np.zeros_like(theta)
        gw, gm, gs, ge = _split(grad)
        scores, off = design @ w, np.zeros((len(labels), 2))
        for lo, hi in zip(cuts, cuts[1:]):
            e, ys, n = scores[lo:hi], labels[lo:hi], hi - lo
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0], behind[-1] = starts + e[0], ends
            for k in range(1, n):
                ahead[k] = np.logaddexp(*(ahead[k - 1][:, None] + moves)) + e[k]
            for k in range(n - 2, -1, -1):
                t = moves + (e[k + 1] + behind[k + 1])[None, :]
                behind[k] = np.logaddexp(t[:, 0], t[:, 1])
            z = np.logaddexp(*(ahead[-1] + ends))
            p = np.exp(ahead + behind - z)
            p[np.arange(n), ys] -= 1  # expected less observed
            off[lo:hi] = p
            gs += p[0]
            ge += p[-1]
            if n > 1:
                pairs = np.exp(ahead[:-1, :, None] + moves[None] + (e[1:] + behind[1:])[:, None, :] - z)
                gm += pairs.sum(axis=0)
                np.subtract.at(gm, (ys[:-1], ys[1:]), 1)
        gw += design.T @ off
        grad = grad / len(pages) + PENALTY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, moves, starts, ends = _split(theta)
    return Field({f: tuple(w[k].tolist()) for f, k in index.items()}, moves.copy(), starts.copy(), ends.copy())


def _split(theta: np.ndarray) -> tuple[np.ndarray, ...]:
    """Views of the parts of a parameter vector."""
    return theta[:-8].reshape(-1, 2), theta[-8:-4].reshape(2, 2), theta[-4:-2], theta[-2:]


def features_of(page: str) -> list[list[str]]:
    return [path_features(b.path) + text_features(b.text, b.linked) for b in blocks(page)]


@lru_cache(maxsize=4)
def model(pages: int = PAGES, seed: int = 11) -> Field:
    """The field trained on the labelled pages."""
    data = []
    for page, truth in labelled_pages(pages, seed):
        found = blocks(page)
        if [b.text for b in found] != [" ".join(t.split()) for t, _ in truth]:
            raise AssertionError("a labelled page isn't cut into its blocks")
        data.append(([path_features(b.path) + text_features(b.text, b.linked) for b in found], [y for _, y in truth]))
    return train(data)


def main_text(page: str, crf: Field) -> str:
    found = blocks(page)
    labels = crf.decode(found)
    return "\n".join(b.text for b, y in zip(found, labels, strict=True) if y == MAIN)


def extract(pages: DataFrame, column: str = "html", crf: Field | None = None) -> DataFrame:
    """``pages`` without its html, with text string and n_chars long."""
    ready(pages.sparkSession)
    crf = crf or model()
    kept = [c for c in pages.columns if c != column]
    names = fresh(pages.drop(column), "text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "", crf) for p in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != column]
    return pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`").cast("string").alias("_html")).mapInArrow(run, ", ".join([*fields, f"`{names[0]}` string", f"`{names[1]}` long"]))


def op9_html_extraction(pages: DataFrame) -> DataFrame:
    return extract(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
