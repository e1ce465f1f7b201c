"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.llm.common import blocks_of

# Elements that begin a block, that have no content, that are never text, and whose end is implied.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas head title".split())
RAW = frozenset("script style textarea title iframe".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
ENDS_P = BLOCKS - {"body", "html", "head", "title", "option", "button", "td", "th", "tr"}

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+", re.S)
DEEPEST = 512  #: open elements that are kept, as in browsers; what is nested deeper has the names of those above
MOST_NAMES = 16  #: names of one element
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: text between block boundaries, with the elements and names above it.

    Character references are decoded, white space becomes single spaces; what is never shown (scripts, styles, comments,
    the head) is left out. A `<` that begins no tag is text, as is one with no `>` after it; a tag with a quote that isn't
    closed ends with the first `>`. Open elements at the end of the page are closed there. The time is linear in the page.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # element, what it adds to the path
    opened: Counter[str] = Counter()  # elements of the stack by name
    deeper: Counter[str] = Counter()  # open elements that the stack has no room for
    path: tuple[str, ...] = ()
    parts: list[str] = []
    linked = hidden = links = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(path, text, linked))
            parts, linked = [], 0

    def put(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) if links else 0

    def pop() -> None:
        nonlocal path, hidden, links
        name, added = stack.pop()
        opened[name] -= 1
        if name in BLOCKS:
            flush()
        hidden -= name in HIDDEN
        links -= name == "a"
        path = path[: len(path) - len(added)]

    at, end, last = 0, len(page), page.rfind(">")
    text_from = 0  # where the text before the next tag begins
    while at < end:
        at = page.find("<", at)
        if at < 0 or at > last and not page.startswith("<!--", at):
            break  # no tag ends any more
        if page.startswith(("<!", "<?"), at):
            put(page[text_from:at])
            stop = page.find("-->", at + 4) if page.startswith("<!--", at) else page.find(">", at)
            at = text_from = end if stop < 0 else stop + (3 if page.startswith("<!--", at) else 1)
            continue
        named = NAME.match(page, at)
        if not named:
            at += 1  # text
            continue
        put(page[text_from:at])
        closing = page[at + 1] == "/"
        begin = named.end()
        stop = ATTRIBUTES.match(page, begin).end()
        if not page.startswith(">", stop):  # a quote that isn't closed
            stop = page.find(">", begin)
        at = text_from = stop + 1
        name = named[1].lower()
        if closing:
            if deeper[name]:
                deeper[name] -= 1
                if name in BLOCKS:
                    flush()
            elif opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID:
            if name in ("br", "hr") and not hidden:
                flush() if name == "hr" else parts.append("\n")
            continue
        implied = CLOSES.get(name, set())
        while stack and (stack[-1][0] in implied or stack[-1][0] not in BLOCKS and name in implied and any(x in implied for x, _ in stack[-3:])):
            pop()
        if name in ENDS_P and any(x == "p" for x, _ in stack[-4:]):
            while stack[-1][0] != "p":
                pop()
            pop()
        if name in BLOCKS:
            flush()
        if name in RAW:
            found = re.compile(rf"</{name}[^<>]*>", re.I).search(page, at)
            raw, at = page[at : found.start() if found else end], found.end() if found else end
            text_from = at
            if name == "textarea" and not hidden:
                parts.append(html.unescape(raw))
                path, above = (*path, "<textarea>"), path
                flush()
                path = above
            continue
        if len(stack) >= DEEPEST:
            deeper[name] += 1
            continue
        said = [x.lower() for m in NAMES.finditer(page, begin, stop) for x in PART.findall(m[1] or m[2] or m[3] or "")][:MOST_NAMES] if stop > begin else []
        added = tuple([f"<{name}>", *(f".{x}" for x in said)]) if name in BLOCKS or said else ()
        stack.append((name, added))
        opened[name] += 1
        path += added
        hidden += name in HIDDEN
        links += name == "a"
    put(page[text_from:])
    flush()
    return out


# --- features -------------------------------------------------------------------------------------

SAID = re.compile(r"©|\b(?:copyright|all rights|cookies?|subscribe|newsletter|log ?in|sign (?:in|up)|comments?|repl(?:y|ies)|share|posted by|privacy|terms|advertisement|sponsored|related|read more)\b", re.I)


def path_features(path: tuple[str, ...]) -> list[str]:
    out = {f"in {x}" for x in path}
    tags = [x for x in path if x[0] == "<"]
    out.update(f"last {x}" for x in tags[-1:])
    out.update(f"two {a}{b}" for a, b in zip(tags[-2:-1], tags[-1:], strict=False))
    return sorted(out)


def text_features(block: Block) -> list[str]:
    n = block.text.count(" ") + 1
    out = [f"words {min(6, int(math.log2(n)))}", f"linked {min(3, 4 * block.linked // max(1, len(block.text)))}"]
    out.append("ends a sentence" if block.text[-1] in ".!?\"”»" else "no end")
    if "," in block.text or ". " in block.text:
        out.append("inner marks")
    if n < 40 and (found := SAID.search(block.text)):
        out.append(f"says {found[0].lower()}")
        out.append("says")
    return out


class Crf:
    """A linear chain with two labels (1: main text): weights of features for label 1, and of label pairs."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.pairs = [[0.0, 0.0], [0.0, 0.0]]
        self.start = [0.0, 0.0]
        self._of_path: dict[tuple[str, ...], float] = {}

    def emission(self, block: Block) -> float:
        get = self.weights.get
        above = self._of_path.get(block.path)
        if above is None:
            if len(self._of_path) > 10_000:
                self._of_path.clear()
            above = self._of_path[block.path] = sum(get(x, 0.0) for x in path_features(block.path))
        return above + sum(get(x, 0.0) for x in text_features(block))

    def decode(self, found: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi); ties go to label 0."""
        if not found:
            return []
        e = [self.emission(b) for b in found]
        zero, one, back = self.start[0], self.start[1] + e[0], []
        (p00, p01), (p10, p11) = self.pairs
        for x in e[1:]:
            a, b, c, d = zero + p00, one + p10, zero + p01, one + p11
            back.append((int(b > a), int(d > c)))
            zero, one = max(a, b), max(c, d) + x
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def train(self, pages: list[tuple[list[Block], list[int]]], rounds: int = 12, rate: float = 0.3, l2: float = 1e-4) -> None:
        """Maximises the conditional log-likelihood by AdaGrad steps, a page at a time (forward-backward in logs)."""
        seen = [([path_features(b.path) + text_features(b) for b in found], y) for found, y in pages if found]
        squares: dict[object, float] = {}
        weights, pairs, start = self.weights, self.pairs, self.start

        def step(key, value: float, g: float) -> float:
            squares[key] = squares.get(key, 1e-6) + g * g
            return float(value + rate * g / math.sqrt(squares[key]))

        order = random.Random(5)
        for _ in range(rounds):
            order.shuffle(seen)
            for feats, y in seen:
                e = np.array([[0.0, sum(weights.get(x, 0.0) for x in f)] for f in feats])
                p, n = np.array(pairs), len(y)
                forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
                forward[0] = np.array(start) + e[0]
                for k in range(1, n):
                    forward[k] = e[k] + np.logaddexp(forward[k - 1, 0] + p[0], forward[k - 1, 1] + p[1])
                for k in range(n - 2, -1, -1):
                    backward[k] = np.logaddexp(p[:, 0] + e[k + 1, 0] + backward[k + 1, 0], p[:, 1] + e[k + 1, 1] + backward[k + 1, 1])
                total = np.logaddexp(*forward[-1])
                marginal = np.exp(forward + backward - total)
                grad: dict[str, float] = {}
                for k, f in enumerate(feats):
                    g = y[k] - marginal[k, 1]
                    for x in f:
                        grad[x] = grad.get(x, 0.0) + g
                for x, g in grad.items():
                    weights[x] = step(x, weights.get(x, 0.0), g - l2 * weights.get(x, 0.0))
                both = np.exp(forward[:-1, :, None] + p[None] + (e[1:] + backward[1:])[:, None, :] - total).sum(0) if n > 1 else np.zeros((2, 2))
                for a in (0, 1):
                    start[a] = step(("start", a), start[a], (y[0] == a) - marginal[0, a])
                    for b in (0, 1):
                        seen_pairs = sum(1 for k in range(1, n) if y[k - 1] == a and y[k] == b)
                        pairs[a][b] = step(("pair", a, b), pairs[a][b], seen_pairs - both[a, b])
        self._of_path.clear()


# --- labelled pages -------------------------------------------------------------------------------


def labelled_pages(n: int = 400, seed: int = 3) -> list[tuple[str, list[str]]]:
    """Pages made by rule in varied layouts, with the text of each main block in order. No language is presumed."""
    r = random.Random(seed)
    syllables = ["".join(r.choice(x) for x in ("bcdfglmnprst", "aeiouéäó", ["", "n", "r", "s", "l"])) for _ in range(80)]

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(r.randint(a, b)))

    def sentence() -> str:
        w = words(4, 18).capitalize()
        return w.replace(" ", ", ", 1) + r.choice(".....!?") if r.random() < 0.4 else w + r.choice(".....!?")

    def para() -> str:
        return " ".join(sentence() for _ in range(r.randint(1, 6)))

    def name(*of: str) -> str:
        kind, k = r.choice(of), r.random()
        return f' class="{kind}"' if k < 0.6 else f' id="{kind}"' if k < 0.8 else f' class="{kind} {r.choice(("box", "wrap", "col", "row"))}"'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def nav() -> str:
        body = links(r.randint(2, 9))
        return f"<nav>{body}</nav>" if r.random() < 0.6 else f"<div{name('menu', 'nav', 'navbar', 'breadcrumb', 'topnav')}>{body}</div>"

    def ad() -> str:
        body = r.choice((sentence(), f'<a href="x">{words(2, 6)}</a>', para()))
        return f"<{(t := r.choice(('div', 'div', 'aside', 'section')))}{name('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo')}>{body}</{t}>"

    def notice() -> str:
        return f"<div{name('cookie', 'notice', 'consent', 'alert', 'gdpr', 'popup')}>{r.choice((sentence(), '<p>' + sentence() + '</p><button>OK</button>'))}</div>"

    def form() -> str:
        return f"<form{name('search', 'login', 'newsletter', 'subscribe', 'contact')}><label>{words(1, 4)}</label><input name=q><textarea>{words(1, 5)}</textarea><select><option>{words(1, 2)}<option>{words(1, 2)}</select><p>{sentence()}</p><button>{words(1, 2)}</button></form>"

    def side() -> str:
        body = f"<h3>{words(1, 3)}</h3>" + r.choice((links(r.randint(2, 6)), f"<p>{para()}</p>", sentence()))
        return f"<aside>{body}</aside>" if r.random() < 0.5 else f"<div{name('sidebar', 'side', 'widget', 'related', 'share', 'social', 'tags')}>{body}</div>"

    def comments() -> str:
        each = "".join(f"<{(t := r.choice(('div', 'li', 'article')))}{name('comment', 'reply')}><b>{words(1, 2)}</b><p>{para()}</p></{t}>" for _ in range(r.randint(1, 4)))
        return f"<{(t := r.choice(('div', 'section')))}{name('comments', 'discussion', 'replies', 'responses', 'disqus')}><h3>{words(1, 3)}</h3>{each}</{t}>"

    def header() -> str:
        body = f"<h2>{words(1, 4)}</h2>" + r.choice(("", f"<p>{sentence()}</p>", nav()))
        return f"<header>{body}</header>" if r.random() < 0.6 else f"<div{name('header', 'masthead', 'top')}>{body}</div>"

    def footer() -> str:
        body = r.choice(("&copy; ", "", "Copyright ")) + f"{words(1, 3)} &middot; " + r.choice((para(), links(3), sentence()))
        return f"<footer>{body}</footer>" if r.random() < 0.7 else f"<div{name('footer', 'foot', 'legal', 'copyright')}>{body}</div>"

    def article() -> tuple[str, list[str]]:
        body, texts = "", []

        def put(opening: str, text: str, closing: str) -> None:
            nonlocal body
            body += opening + text + closing
            texts.append(text)

        put("<h1>", words(2, 9), "</h1>")
        for _ in range(r.randint(1, 9)):
            k = r.random()
            if k < 0.62:
                put("<p>", para(), r.choice(("</p>", "</p>", "")))
            elif k < 0.7:
                put("<h2>", words(2, 6), "</h2>")
            elif k < 0.76:
                body += "<ul>"
                for _ in range(r.randint(2, 5)):
                    put("<li>", r.choice((words(2, 8), sentence())), "</li>")
                body += "</ul>"
            elif k < 0.82:
                body += "<table><tr>"
                for _ in range(r.randint(2, 4)):
                    put("<td>", words(1, 5), "</td>")
                body += "</tr></table>"
            elif k < 0.88:
                put("<blockquote>", para(), "</blockquote>")
            elif k < 0.92:
                put("<pre>", words(3, 12), "</pre>")
            elif k < 0.96:
                put("<div>", para(), "</div>")
            else:
                body += r.choice((ad, side))()
        kind = r.random()
        if kind < 0.4:
            return f"<article>{body}</article>", texts
        if kind < 0.55:
            return f"<main>{body}</main>", texts
        if kind < 0.9:
            return f"<div{name('content', 'article', 'post', 'entry', 'story', 'main', 'text', 'body')}>{body}</div>", texts
        return f"<section>{body}</section>", texts

    out = []
    for _ in range(n):
        main, texts = article()
        before = "".join(x() for x in r.sample([nav, header, ad, notice, form, side], r.randint(1, 4)))
        after = "".join(x() for x in r.sample([comments, side, ad, form, footer, nav, notice], r.randint(1, 4)))
        shell = r.choice(("{}", "<div>{}</div>", '<div id="wrap">{}</div>', '<div class="container page">{}</div>'))
        out.append((f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><script>var a='<p>';</script></head><body>" + shell.format(before + main + after) + "</body></html>", texts))
    return out


def label(found: list[Block], main: list[str]) -> list[int]:
    """1 for the blocks whose texts are the main ones, matched in order."""
    out, k = [], 0
    for b in found:
        hit = k < len(main) and b.text == main[k]
        out.append(int(hit))
        k += hit
    return out


def trained(pages: list[tuple[str, list[str]]] | None = None) -> Crf:
    """A field trained on labelled pages (page, texts of its main blocks); without any, on labelled_pages()."""
    model = Crf()
    rows = []
    for page, main in labelled_pages() if pages is None else pages:
        found = blocks(page)
        rows.append((found, label(found, main)))
    model.train(rows)
    return model


def main_text(page: str | None, model: Crf) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, y in zip(found, model.decode(found), strict=True) if y)


def extract(pages: DataFrame, model: Crf) -> DataFrame:
    """pages(page_id, url, html, ...) as (page_id, url, text, n_chars): each row's main text, '' if there is none.

    null html counts as empty. Every row counts for itself, repeated ones alike; the whole html is read, however long; an
    empty table gives an empty one; extra columns are ignored.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches):
        model = held.value
        for batch in batches:
            for part in blocks_of(batch, "html", 1 << 23):
                texts = [main_text(x, model) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.fieldNames())

    return pages.select("page_id", "url", "html").mapInArrow(work, schema)
