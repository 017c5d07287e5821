"""Main text of HTML pages by the maximum-scoring subsequence.

A page is read as a sequence of tags and words.  Words score positive and tags
negative by weights learned from labelled pages (`labelled_pages`): the log-odds of
a token kind being inside the main text rather than outside.  Tag kinds are
opening or closing and the name; word kinds are the block that holds the word (and
whether it stands in page furniture).  One linear scan finds the contiguous
region with the highest sum.  The region is then widened to the ends of the
innermost element that holds it whole, so that neither a heading nor a last short
paragraph is cut off, and furniture inside it is left out.

Furniture are the elements of the HTML standard that hold menus, sidebars, footers,
forms, scripts and the like, elements with such a role or that are hidden, and
elements with a class or id of which a word was learned to stand outside the main text
and every other word says nothing (``comments-area``, but not ``legal-history`` or
``discussion``).  Attributes are read by name.

Text: character references decoded; white space inside a block becomes one space;
blocks are trimmed and joined by a newline in page order; empty blocks vanish; a
``<br>`` and every other element that is not inline starts a block; formulas are inline text.

Time and memory are linear in the page, however deep its elements are nested.

Defined cases: null or empty html gives the empty text; a page without words gives
the empty text; a tag that the end of the page cuts off is dropped, text that it
cuts off stays; a ``<`` that no tag follows is text; null or repeated page_ids are
carried through, one output row per input row; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Elements of the HTML standard by the part they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes title svg".split())
FORMULA = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle semantics annotation".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split()) | FORMULA
FURNITURE_TAGS = frozenset("nav footer aside form head menu dialog button select option fieldset object embed audio video canvas map".split()) | RAW
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
CONTENT_TAGS = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": ("li", "ul", "ol"), "dt": ("dt", "dd", "dl"), "dd": ("dt", "dd", "dl"), "tr": ("tr", "table"), "td": ("td", "th", "tr", "table"), "th": ("td", "th", "tr", "table"), "option": ("option", "select")}

# Classes and ids of page furniture, of content, and words in them that say nothing.
FURNITURE_CLASSES = """ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo nav navbar navigation menu
    breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar comment comments commentlist disqus respond cookie cookies consent gdpr notice notices alert popup
    modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager skip""".split()
CONTENT_CLASSES = "text entry story lead legal discussion history search status reply feedback disclaimer copyright promotion header title analysis results summary map quote abstract reference references".split()
NEUTRAL = frozenset("area bar block body box btn button buttons center column container content group holder icon id inner item items js left link links list main module outer page panel post posts right row section site slot space the top bottom unit view wrap wrapper".split())

_TAG = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:-->|$)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)*))(?P<end>>|$)|(?P<other>[!?/][^>]*)(?:>|$))",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_WORDS = re.compile(r"[a-z]+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)


def attributes(attrs: str) -> dict[str, str]:
    """Names in lower case to values; the first of a name counts."""
    out: dict[str, str] = {}
    for key, value in _ATTRIBUTE.findall(attrs):
        out.setdefault(key.lower(), value.strip("\"'").lower())
    return out


def class_words(attrs: dict[str, str]) -> list[list[str]]:
    """The words of each class and of the id."""
    return [words for key in ("class", "id") for token in attrs.get(key, "").split() if (words := _WORDS.findall(token))]


def marked_as_furniture(name: str, attrs: dict[str, str]) -> bool:
    """Whether tag, role or visibility alone say so."""
    if name in FURNITURE_TAGS:
        return True
    if not attrs or name in ("body", "html"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in FURNITURE_ROLES or bool(_HIDDEN_STYLE.search(attrs.get("style", "")))


class Page:
    """Tokens (kind, count, text, element, block) in page order, and the tree of elements.

    kind is (open or close, name) or (word, name of the block); element is the number of
    the innermost element, 0 the page itself.
    """

    def __init__(self, html: str, outside: dict[str, float]):
        self.tokens: list[tuple] = []
        # of each element: the one above, whether it is furniture, its block, first token, last token + 1
        self.parent, self.furniture, self.block_name, self.start, self.end = [0], [False], [""], [0], [-1]
        self.classes: list[tuple[list[list[str]], int]] = []  # classes met, and at which token
        stack: list[tuple[str, int]] = []
        at_name: dict[str, list[int]] = defaultdict(list)  # name to its places in the stack
        solid: list[int] = []  # places in the stack of elements that are not inline
        block = at = 0

        def here() -> int:
            return stack[-1][1] if stack else 0

        def text_run(raw: str) -> None:
            if raw:
                e = here()
                self.tokens.append((("word", "furniture" if self.furniture[e] else self.block_name[e]), len(raw.split()), raw, e, block))

        def pop_to(k: int) -> None:
            while len(stack) > k:
                name, e = stack.pop()
                at_name[name].pop()
                if solid and solid[-1] == len(stack):
                    solid.pop()
                self.end[e] = len(self.tokens)

        def last(name: str) -> int:
            held = at_name.get(name)
            return held[-1] if held else -1

        for begin, upto, name, close, attrs, self_closed in _tags(html):
            text_run(html[at:begin])
            at = upto
            if name is None:
                continue
            inline = name in INLINE
            if not inline:
                block += 1
            if close:
                self.tokens.append((("close", name), 1, None, here(), block))
                k = last(name)
                if k >= 0 and not (inline and solid and solid[-1] > k):
                    pop_to(k)
                continue
            if name in CLOSES_P:
                k = last("p")
                if k >= 0 and solid[-1] == k:
                    pop_to(k)
            elif name in ITEMS:
                k = max(map(last, ITEMS[name]))
                if k >= 0 and stack[k][0] in ITEMS and stack[k][0] != ("tr" if name in ("td", "th") else ""):
                    pop_to(k)
            above = here()
            found = attributes(attrs) if attrs else {}
            # a heading block of the article itself is not the header of the page
            own = name == "header" and not any(last(n) >= 0 for n in CONTENT_TAGS) or marked_as_furniture(name, found)
            if found and name not in CONTENT_TAGS and name not in ("body", "html"):
                classes = class_words(found)
                if classes:
                    self.classes.append((classes, len(self.tokens)))
                    own = own or any(any(outside.get(w, 0.0) < -1.0 for w in words) and all(w in NEUTRAL or outside.get(w, 0.0) < -1.0 for w in words) for words in classes)
            self.tokens.append((("open", name), 1, None, above, block))
            if name in VOID or self_closed:
                continue
            e = len(self.parent)
            self.parent.append(above)
            self.furniture.append(self.furniture[above] or own)
            self.block_name.append(self.block_name[above] if inline else name)
            self.start.append(len(self.tokens))
            self.end.append(-1)
            at_name[name].append(len(stack))
            if not inline:
                solid.append(len(stack))
            stack.append((name, e))
        text_run(html[at:])
        pop_to(0)
        self.end[0] = len(self.tokens)


_raw_ends: dict[str, re.Pattern] = {}


def _tags(html: str) -> Iterator[tuple]:
    """(start, end, name or None, closing, attributes, self-closed); raw elements are one tag with their content."""
    at = 0
    while (m := _TAG.search(html, at)) is not None:
        at = m.end()
        name = m["name"]
        if name is None:
            yield m.start(), at, None, False, "", False
            continue
        name, attrs = name.lower(), m["attrs"]
        closed = attrs.endswith("/") and (name == "svg" or name in FORMULA)  # only foreign elements close themselves
        if not m["close"] and name in RAW and not closed:
            if name not in _raw_ends:
                _raw_ends[name] = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I)
            end = _raw_ends[name].search(html, at)
            if end or name != "svg":
                at = end.end() if end else len(html)
            closed = True
        yield m.start(), at, name, bool(m["close"]), attrs, closed


# ---- weights from labelled pages


def labelled_pages(n: int = 120, seed: int = 7) -> list[str]:
    """Made-up pages; the main text stands between the comments ``<!--[-->`` and ``<!--]-->``."""
    rnd = random.Random(seed)
    nth = iter(range(10**9))

    def words(low, high):
        return " ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(low, high)))

    def links(k):
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 2)}</a></li>' for _ in range(k))

    def furniture():  # every class in turn
        return f'<div class="{FURNITURE_CLASSES[next(nth) * 7 % len(FURNITURE_CLASSES)]}"><p>{words(4, 20)}</p></div>'

    out = []
    for i in range(n):
        before = [f"<nav><ul>{links(rnd.randint(3, 9))}</ul></nav>", furniture(), f"<header><h2>{words(1, 4)}</h2><p>{words(2, 6)}</p></header>", f'<form action="/s"><input name="q"><button>{words(1, 1)}</button></form>', furniture()]
        after = [f"<footer>&copy; {words(3, 12)}</footer>", f'<aside><h3>{words(1, 3)}</h3><ul>{links(4)}</ul></aside>', f'<section class="comments"><h3>{words(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{words(4, 30)}</p></div>' for _ in range(3)) + "</section>", furniture(), furniture(), *([f'<div class="{rnd.choice(CONTENT_CLASSES)}">{words(2, 9)}</div>'] * (rnd.random() < 0.3))]
        body = [f"<h1>{words(3, 10)}</h1><p>{words(10, 60)}</p>", f'<section class="{CONTENT_CLASSES[i % len(CONTENT_CLASSES)]}"><h2>{words(2, 5)}</h2><p>{words(10, 60)}</p></section>']
        for _ in range(rnd.randint(2, 9)):
            body.append(rnd.choice([f"<p>{words(10, 90)}</p>"] * 6 + [f"<h2>{words(2, 7)}</h2>", f"<ul><li>{words(3, 12)}</li><li>{words(3, 12)}</li></ul>", f"<p>{words(10, 40)} <a href=\"#\">{words(1, 3)}</a> <b>{words(1, 3)}</b> {words(5, 20)}<br>{words(5, 20)}</p>", f"<blockquote><p>{words(8, 30)}</p></blockquote>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>"]))
        opening, closing = rnd.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post">', "</div>"), ('<div id="content"><div>', "</div></div>")])
        pick = [x for x in before if rnd.random() < 0.6], [x for x in after if rnd.random() < 0.6]
        out.append(f"<html><head><title>{words(2, 8)}</title></head><body>{''.join(pick[0])}<!--[-->{opening}{''.join(body)}{closing}<!--]-->{''.join(pick[1])}</body></html>")
    return out


def _spans(pages: list[str], outside: dict[str, float]) -> Iterator[tuple[Page, int, int]]:
    """Each page, and the tokens between which its main text stands."""
    for page in pages:
        start, end = page.index("<!--[-->"), page.index("<!--]-->")
        yield Page(page, outside), len(Page(page[:start], outside).tokens), len(Page(page[:end], outside).tokens)


def learn_classes(pages: list[str], smooth: float = 0.5) -> dict[str, float]:
    """Log-odds of a class or id with the word: inside the main text against outside."""
    counts = Counter(), Counter()
    for page, start, end in _spans(pages, {}):
        for classes, at in page.classes:
            counts[not start <= at < end].update(w for words in classes for w in words)
    return {w: math.log((counts[0][w] + smooth) / (counts[1][w] + smooth)) for w in {*counts[0], *counts[1]}}


def learn_weights(pages: list[str], classes: dict[str, float], smooth: float = 1.0) -> dict:
    """Log-odds of each token kind, words kept at or above a small positive weight and tags at or below a negative one."""
    counts = Counter(), Counter()
    for page, start, end in _spans(pages, classes):
        for i, t in enumerate(page.tokens):
            counts[not start <= i < end][t[0]] += t[1]
    total = [sum(c.values()) + smooth for c in counts]
    out = {}
    for kind in {*counts[0], *counts[1]}:
        odds = math.log((counts[0][kind] + smooth) / total[0]) - math.log((counts[1][kind] + smooth) / total[1])
        if kind[0] == "word":
            out[kind] = -0.05 if kind[1] == "furniture" else max(0.1, odds)
        else:
            out[kind] = min(-0.1, odds / 4)
    return out


_model: list[dict] = []


def model() -> list[dict]:
    """[log-odds of class words, weights of token kinds]"""
    if not _model:
        pages = labelled_pages()
        classes = learn_classes(pages)
        _model.extend([classes, learn_weights(pages, classes)])
    return _model


# ---- extraction


def best_region(scores: list[float]) -> tuple[int, int]:
    """The slice with the highest sum, the first and shortest on ties; empty if nothing is positive."""
    best = run = 0.0
    at = start = end = 0
    for i, s in enumerate(scores):
        if run <= 0.0:
            run, at = s, i
        else:
            run += s
        if run > best:
            best, start, end = run, at, i + 1
    return start, end


_SPACE = re.compile(r"\s+")


def main_text(html: str | None) -> str:
    if not html:
        return ""
    classes, w = model()
    page = Page(html, classes)
    scores = [w.get(kind, 0.3 if kind[0] == "word" else -0.3) * count for kind, count, _, _, _ in page.tokens]
    start, end = best_region(scores)
    inside = [i for i in range(start, end) if page.tokens[i][1] and page.tokens[i][0][0] == "word" and page.tokens[i][0][1] != "furniture"]
    if not inside:
        return ""
    # the innermost element that holds the region whole
    first, last = inside[0], inside[-1]
    around = page.tokens[first][3]
    while page.end[around] <= last:
        around = page.parent[around]
    if page.tokens[first][4] == page.tokens[last][4]:
        around = page.parent[around]  # one block only: what its element's parent holds
    blocks: list[list] = []
    for kind, _, text, _, block in page.tokens[page.start[around] : page.end[around]]:
        if kind[0] == "word" and kind[1] != "furniture":
            if blocks and blocks[-1][0] == block:
                blocks[-1][1].append(text)
            else:
                blocks.append([block, [text]])
    lines = (_SPACE.sub(" ", unescape("".join(texts))).strip() for _, texts in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    common.arrow_rows(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
