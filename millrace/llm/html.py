"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read once, from its start: comments, markup and raw-text elements go,
and text between block-level tags is a block.  Each block has features of its
open elements (tags, words of class, id and role) and of its text (length, share
of link text, closing punctuation, ...).  The field has a weight for each feature
and for each pair of neighbouring labels; it is trained by maximum likelihood on
labelled pages (`training_pages` makes them from layout rules), and blocks are
labelled by Viterbi decoding.  Open elements' weights are kept summed, so that
time is linear in the page whatever the depth.

Defined results: null and empty pages, and pages without any kept block, have an
empty text; unclosed comments and raw-text elements reach to the end; a cut
character reference is decoded as HTML5 does; equal pages have equal texts.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import frugal, pick, slices, strings

# Elements by their kind in HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "select", "svg", "iframe", "object", "xmp", "noembed", "noframes")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
CLOSES_P = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))

# Quotes count after = only; a tag that is never closed reaches to the end, as in HTML.
_REST = r"(?:[^>=]|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+(?:>|\Z)"
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b{_REST}(?:.*?</(?P=raw)\s*+>|.*\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>{_REST})"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_BLANK = re.compile(r"\s+")


def element_features(tag: str, rest: str) -> tuple[str, ...]:
    found = {"in:" + tag}
    if "=" in rest:
        for names in _NAMES.findall(rest):
            found.update("named:" + w.lower() for w in _WORD.findall("".join(names)))
    return tuple(sorted(found))


def text_features(text: str, linked: int, tag: str) -> tuple[str, ...]:
    n = len(text)
    share = linked / n
    return (
        "bias",
        "size:" + ("0" if n < 25 else "1" if n < 80 else "2" if n < 250 else "3"),
        "links:" + ("0" if share < 0.1 else "1" if share < 0.6 else "2"),
        "end:" + ("1" if text[-1] in ".!?…:;\"'»”" else "0"),
        "own:" + tag,
        "legal:" + ("1" if "©" in text or "rights reserved" in text.lower() else "0"),
    )


class _Page:
    """Blocks in page order, each with the elements that are open around it."""

    def __init__(self, on_open, on_close):
        self.on_open, self.on_close = on_open, on_close

    def blocks(self, page: str) -> Iterator[tuple[str, int, str]]:
        """(text, characters in links, innermost block element); the open elements are those at the time."""
        stack: list[tuple[str, object]] = []
        opened: Counter[str] = Counter()
        pieces: list[str] = []
        linked = 0

        def close(upto: str) -> None:
            while stack:
                tag, token = stack.pop()
                opened[tag] -= 1
                self.on_close(token)
                if tag == upto:
                    return

        def taken() -> tuple[str, int, str] | None:
            nonlocal linked
            text = _BLANK.sub(" ", entities.unescape("".join(pieces))).strip()
            n, linked = linked, 0
            pieces.clear()
            return (text, min(n, len(text)), next((t for t, _ in reversed(stack) if t not in INLINE), "")) if text else None

        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                piece = page[at : m.start()]
                pieces.append(piece)
                if opened["a"]:
                    linked += len(piece)
            at = m.end()
            name = m["tag"]
            if name is None:
                continue
            tag = name.lower()
            if tag == "br":
                pieces.append(" ")
                continue
            if tag not in INLINE and pieces and (block := taken()):
                yield block
            if m["close"]:
                if opened[tag]:
                    close(tag)
                continue
            if tag in CLOSES_P and opened["p"]:
                close("p")
            elif tag in ("li", "tr", "td", "th", "option", "dd", "dt") and stack and stack[-1][0] == tag:
                close(tag)
            if tag in VOID or m["rest"].endswith("/>"):
                continue
            stack.append((tag, self.on_open(tag, m["rest"])))
            opened[tag] += 1
        if at < len(page):
            pieces.append(page[at:])
        if pieces and (block := taken()):
            yield block


def page_features(page: str) -> list[tuple[str, set[str]]]:
    """(text, features) of each block; for training."""
    present: Counter[str] = Counter()

    def on_open(tag: str, rest: str) -> tuple[str, ...]:
        found = element_features(tag, rest)
        present.update(found)
        return found

    def on_close(found: tuple[str, ...]) -> None:
        present.subtract(found)

    return [(text, {f for f, n in present.items() if n > 0} | set(text_features(text, linked, tag))) for text, linked, tag in _Page(on_open, on_close).blocks(page)]


@dataclass
class Field:
    """Weights for the label "main text" over "other", and for neighbouring labels."""

    weights: dict[str, float]
    pair: list[list[float]]

    def extract(self, page: str) -> str:
        weights = self.weights
        present: Counter[str] = Counter()
        elements: dict[tuple[str, str], tuple[str, ...]] = _elements
        total = 0.0

        def on_open(tag: str, rest: str) -> tuple[str, ...]:
            nonlocal total
            found = elements.get((tag, rest))
            if found is None:
                if len(elements) > 50_000:
                    elements.clear()
                found = elements[tag, rest] = element_features(tag, rest)
            for f in found:
                present[f] += 1
                if present[f] == 1:
                    total += weights.get(f, 0.0)
            return found

        def on_close(found: tuple[str, ...]) -> None:
            nonlocal total
            for f in found:
                present[f] -= 1
                if not present[f]:
                    total -= weights.get(f, 0.0)

        texts: list[str] = []
        scores: list[float] = []
        for text, linked, tag in _Page(on_open, on_close).blocks(page):
            texts.append(text)
            scores.append(total + sum(weights.get(f, 0.0) for f in text_features(text, linked, tag)))
        return "\n".join(t for t, keep in zip(texts, self.viterbi(scores), strict=True) if keep)

    def viterbi(self, scores: list[float]) -> list[int]:
        if not scores:
            return []
        (a, b), (c, d) = self.pair
        zero, one = 0.0, scores[0]
        back = []
        for s in scores[1:]:
            from0, from1 = zero + a >= one + c, zero + b >= one + d
            back.append((0 if from0 else 1, 0 if from1 else 1))
            zero, one = (zero + a if from0 else one + c), (zero + b if from1 else one + d) + s
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


_elements: dict[tuple[str, str], tuple[str, ...]] = {}


def _add(x: float, y: float) -> float:
    top = max(x, y)
    return top + math.log(math.exp(x - top) + math.exp(y - top))


def train(pages: list[list[tuple[set[str], int]]], rounds: int = 25, rate: float = 0.5, ridge: float = 2e-4) -> Field:
    """Maximum likelihood by adaptive gradient steps; pages are (features, label) of their blocks in order."""
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    pair = [[0.0, 0.0], [0.0, 0.0]]
    pair_squares = [[1e-6, 1e-6], [1e-6, 1e-6]]
    for _ in range(rounds):
        for page in pages:
            scores = [sum(weights.get(f, 0.0) for f in found) for found, _ in page]
            n = len(page)
            ahead = [(0.0, scores[0])]
            for s in scores[1:]:
                x, y = ahead[-1]
                ahead.append((_add(x + pair[0][0], y + pair[1][0]), _add(x + pair[0][1], y + pair[1][1]) + s))
            behind = [(0.0, 0.0)] * n
            for i in range(n - 2, -1, -1):
                x, y = behind[i + 1]
                behind[i] = (_add(pair[0][0] + x, pair[0][1] + scores[i + 1] + y), _add(pair[1][0] + x, pair[1][1] + scores[i + 1] + y))
            whole = _add(*ahead[-1])
            for i, (found, label) in enumerate(page):
                g = label - math.exp(min(0.0, ahead[i][1] + behind[i][1] - whole))
                if abs(g) > 1e-4:
                    for f in found:
                        step = g - ridge * weights.get(f, 0.0)
                        squares[f] = squares.get(f, 1e-6) + step * step
                        weights[f] = weights.get(f, 0.0) + rate * step / math.sqrt(squares[f])
            for u in (0, 1):
                for v in (0, 1):
                    g = sum((page[i][1] == u and page[i + 1][1] == v) - math.exp(min(0.0, ahead[i][u] + pair[u][v] + (scores[i + 1] if v else 0.0) + behind[i + 1][v] - whole)) for i in range(n - 1))
                    pair_squares[u][v] += g * g
                    pair[u][v] += 0.2 * rate * g / math.sqrt(pair_squares[u][v])
    return Field(weights, pair)


# ---- labelled pages

_SYLLABLES = "ra ne to li mo ka se du vi or en al is un pe che ta ro mi lo".split()


def _words(rng: random.Random, least: int, most: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(least, most)))


def training_pages(n: int = 300, seed: int = 7) -> list[list[tuple[set[str], int]]]:
    """Pages made by rules of common layouts; the main text carries a mark that tells its blocks."""
    rng = random.Random(seed)
    return [_labelled(_layout(rng)) for _ in range(n)]


_MARK = "\x02"


def _labelled(page: str) -> list[tuple[set[str], int]]:
    marked, plain = page_features(page), page_features(page.replace(_MARK, ""))
    return [(found, int(_MARK in text)) for (text, _), (_, found) in zip(marked, plain, strict=True)]


def _layout(rng: random.Random) -> str:
    pick_ = rng.choice

    def sentence(a: int = 4, b: int = 30) -> str:
        return _words(rng, a, b).capitalize() + pick_((".", ".", ".", "!", "?", ""))

    def main(tag: str, text: str) -> str:
        return f"<{tag}>{_MARK}{text}" + (f"</{tag}>" if rng.random() < 0.85 or tag != "p" else "")

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{_words(rng, 1, 1)}">{_words(rng, 1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def other(names: tuple[str, ...], body: str, tags: tuple[str, ...] = ("div", "section", "aside")) -> str:
        tag = pick_(tags)
        return f'<{tag} {pick_(("class", "id"))}="{pick_(names)}">{body}</{tag}>'

    def boxes(spots: tuple[str, ...]) -> str:
        made = {
            "nav": lambda: pick_((f"<nav>{links(rng.randint(2, 7))}</nav>", other(("menu", "navbar", "nav main-nav", "breadcrumb", "topmenu"), links(rng.randint(2, 7))))),
            "header": lambda: f"<header><a href='/'>{_words(rng, 1, 2)}</a><p>{sentence(2, 8)}</p></header>",
            "ad": lambda: other(("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot"), pick_((sentence(), f"<p>{sentence()}</p>", f"<a href='#'>{sentence(2, 6)}</a>"))),
            "notice": lambda: other(("cookie", "cookie-notice", "notice", "consent", "gdpr", "alert"), f"<p>{sentence()}</p><button>{_words(rng, 1, 2)}</button>"),
            "aside": lambda: pick_((f"<aside><h3>{_words(rng, 1, 3)}</h3>{links(rng.randint(2, 5))}<p>{sentence()}</p></aside>", other(("sidebar", "related", "widget", "recommended", "share", "social"), f"<h4>{_words(rng, 1, 3)}</h4>{links(3)}<p>{sentence()}</p>"))),
            "form": lambda: f"<form><label>{_words(rng, 1, 3)}</label><input><button>{_words(rng, 1, 1)}</button><p>{sentence(3, 10)}</p></form>",
            "comments": lambda: pick_((other(("comments", "comment-list", "reader comments", "discussion"), f"<h3>{_words(rng, 1, 3)}</h3>" + "".join(f"<div class='comment'><b>{_words(rng, 1, 2)}</b><p>{sentence()}</p></div>" for _ in range(rng.randint(1, 5)))), f"<section id='comments'><article class='comment'><p>{sentence()}</p></article><article class='comment'><p>{sentence()}</p></article></section>")),
            "footer": lambda: pick_((f"<footer>&copy; {_words(rng, 1, 3)} &middot; {sentence(2, 10)}</footer>", f"<footer><p>{sentence()}</p>{links(3)}</footer>", other(("footer", "site-footer", "copyright"), sentence()))),
        }
        return "".join(made[spot]() for spot in spots if rng.random() < 0.6)

    body = [main(pick_(("h1", "h1", "h2")), sentence(1, 8))] if rng.random() < 0.85 else []
    for _ in range(rng.randint(1, 10)):
        kind = rng.random()
        if kind < 0.72:
            body.append(main("p", sentence(1, 40) + pick_(("", f" <b>{_words(rng, 1, 4)}</b> {sentence()}", f' <a href="/x">{_words(rng, 1, 3)}</a> {sentence()}'))))
        elif kind < 0.78:
            body.append(f"<p><b>{_MARK}{sentence(1, 20)}<br><p>{_MARK}{sentence()}</p>")
        elif kind < 0.84:
            body.append(main(pick_(("h2", "h3")), _words(rng, 1, 6)))
        elif kind < 0.9:
            body.append("<ul>" + "".join(main("li", sentence(1, 10)) for _ in range(rng.randint(2, 4))) + "</ul>")
        elif kind < 0.95:
            body.append(f"<blockquote>{main('p', sentence())}</blockquote>")
        else:
            body.append(main("pre", sentence()))
        if rng.random() < 0.08:
            body.append(boxes(("ad", "aside", "form")))
    tag, names = pick_((("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="content"'), ("div", ' class="article-body"'), ("div", ' class="entry post"'), ("section", ' class="story"')))
    core = f"<{tag}{names}>{''.join(body)}</{tag}>"
    if rng.random() < 0.3:
        core = f"<main>{core}{boxes(('aside',))}</main>" if tag != "main" else core
    head = f"<head><title>{sentence(1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{boxes(('notice', 'header', 'nav', 'ad'))}<!-- x -->{boxes(('ad', 'aside'))}{core}{boxes(('ad', 'aside', 'comments', 'form', 'nav'))}{boxes(('footer',))}" + pick_(("</body></html>", ""))


def learn() -> Field:
    return train(training_pages())


def extract(pages: DataFrame, field: Field, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text (main text, one line a block) and n_chars of every page."""
    source = pick(pages, page_id=page_id, url=url, html=html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [field.extract(p) for p in strings(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(frugal(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
