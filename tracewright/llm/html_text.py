"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of tags and of blocks of words. Every word scores by where it stands, every tag negative; the
weights are those of a logistic regression on pages labelled by hand (pages_labelled), on the names, classes and ids of the
elements around a block, its length, its links and its end. One linear scan finds the contiguous region with the largest sum. Blocks in it that stand in
elements of another kind (adverts, notices and the like between paragraphs) are left out: a second regression, on elements alone, tells which, so a paragraph or list
of the article stays however short it is and whether it is all links.

A page is read in one pass whose time grows with its length alone, whatever it holds: the marks of all elements around a word count, but each element adds its own
marks to the sums of the one around it, so neither their number nor the depth is limited.

Defined cases: a null or empty html, or a page without a region over 0, has an empty text; of equal sums the first region
counts; unclosed and stray tags are read as browsers mostly do; a tag, comment, script or the like that the page doesn't close ends it; repeated rows and nulls in page_id or url come
back as they came; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache
from math import tanh

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table
from .pages_labelled import LAYOUTS, composed, parts

# Elements by what they do to the text around them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page.
HIDDEN = frozenset("script style textarea noscript template svg math title iframe xmp noframes noembed object canvas audio video".split())
#: Of these, those that a page ends in where it doesn't close them.
RAW = frozenset("script style textarea title iframe xmp noframes noembed".split())
ENDS_P = BLOCKS - {"body", "html", "head", "caption", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "label", "button", "select"}
#: Elements that end those of the same row when they start.
CLOSES = {name: group for group in (("li",), ("dt", "dd"), ("option",), ("tr",), ("td", "th"), ("p",)) for name in group}

SPACES, KEY, EQUALS, BARE = re.compile(r"[\s/]*"), re.compile(r"[^\s/>][^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
COMMENT_END = re.compile("--!?>")
PLAIN = re.compile(r"([a-zA-Z][a-zA-Z0-9]*)>")
PIECES = re.compile(r"[a-z]+")
#: Class names that tell a state of the page, not what an element is.
STATES = ("has-", "with-", "no-", "is-", "has_", "with_", "no_", "is_")


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


def attributes(page: str, at: int) -> tuple[dict[str, str] | None, int]:
    """Attributes of a tag from behind its name on, and the place behind it; None where the page doesn't close it."""
    found: dict[str, str] = {}
    while True:
        at = SPACES.match(page, at).end()
        if at >= len(page):
            return None, at
        if page[at] == ">":
            return found, at + 1
        m = KEY.match(page, at)
        key, value, at = m[0].lower(), "", m.end()
        if m := EQUALS.match(page, at):
            at = m.end()
            quote = page[at : at + 1]
            if quote and quote in "\"'":
                end = page.find(quote, at + 1)
                if end < 0:
                    return None, len(page)
                value, at = page[at + 1 : end], end + 1
            else:
                m = BARE.match(page, at)
                value, at = m[0], m.end()
        found.setdefault(key, value)


def tokens(page: str):
    """("text", text, None), ("start", name, attributes) and ("end", name, None) in order."""
    at, n, missing = 0, len(page), set()
    while at < n:
        lt = page.find("<", at)
        while lt >= 0 and not (page[lt + 1 : lt + 2].isascii() and (page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] in ("/", "!", "?"))):
            lt = page.find("<", lt + 1)
        if lt < 0:
            yield "text", page[at:], None
            return
        if lt > at:
            yield "text", page[at:lt], None
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                at = page.index(">", lt) + 1
                continue
            end = COMMENT_END.search(page, lt + 4)
            if not end:
                return
            at = end.end()
            continue
        end_tag = page[lt + 1] == "/"
        m = NAME.match(page, lt + 1 + end_tag)
        if not m:
            at = page.find(">", lt) + 1
            if not at:
                return
            continue
        if plain := PLAIN.match(page, lt + 1 + end_tag):
            own, at, name = {}, plain.end(), plain[1].lower()
        else:
            name = m[0].lower()
            own, at = attributes(page, m.end())
            if own is None:
                return
        if end_tag:
            yield "end", name, None
            continue
        yield "start", name, own
        if name in HIDDEN and name not in missing:
            close = _closing(name).search(page, at)
            if close:
                own, at = attributes(page, close.end())
                if own is None:
                    return
                yield "end", name, None
            elif name in RAW:
                return
            else:
                missing.add(name)


class Open:
    """An open element: its own marks, the element around it, and what the marks of both score.

    Those up to the closest article or main score as near, those around that as far; later is what the near ones will score once they are far. Each is a
    score with the words and one of the elements alone.
    """

    __slots__ = ("name", "own", "up", "scope", "form", "block", "near", "far", "later", "in_form", "home", "known", "inside")

    def __init__(self, name: str, own: frozenset, up: Open | None) -> None:
        self.name, self.own, self.up, self.scope = name, own, up, name in SCOPES
        self.form, self.block, self.home, self.in_form = (up.form, up.block, up.home, up.in_form) if up else (None, "", False, False)
        self.near = self.far = self.later = (0.0, 0.0)
        #: Whether it has been scored, and elements in it by name and marks, since equal ones say the same.
        self.known, self.inside = False, {}

    def around(self) -> tuple[set[str], set[str]]:
        """The marks near and far."""
        near, far, now, at = set(), set(), True, self
        while at is not None:
            (near if now else far).update(at.own)
            now, at = now and not at.scope, at.up
        return near, far


def marks(name: str, own: dict[str, str]) -> frozenset:
    """What an element is: its name if it is a block, the words of its classes, id and role."""
    out = {f"<{name}>"} if name in BLOCKS else set()
    if own and name not in ("html", "body"):
        for key in ("class", "id", "role"):
            for whole in own.get(key, "").lower().split():
                if not whole.startswith(STATES):
                    out.update(w.removesuffix("s") for w in PIECES.findall(whole))
    return frozenset(out)


class Block:
    """A run of words without a block's border in it."""

    __slots__ = ("at", "texts", "words", "linked")

    def __init__(self, at: Open) -> None:
        self.at = at
        self.texts: list[str] = []
        self.words = self.linked = 0


#: Elements that an article stands in, and the mark of forms, which counts for near words alone, and not for those of a form that holds the page.
SCOPES, FORM = ("article", "main"), "<form>"


NOTHING = (0.0, 0.0)


@dataclass
class Weights:
    """Weights of features of blocks, of those of elements when they stand alone, and of tags."""

    blocks: dict[str, float]
    elements: dict[str, float]
    tags: dict[str, float]

    def __post_init__(self) -> None:
        self.both = {key: (self.blocks.get(key, 0.0), self.elements.get(key, 0.0)) for key in {*self.blocks, *self.elements}}

    def of(self, key: str) -> tuple[float, float]:
        return self.both.get(key, NOTHING)


def plus(x: tuple[float, float], y: tuple[float, float]) -> tuple[float, float]:
    return x[0] + y[0], x[1] + y[1]


class Marks:
    """The marks of all open elements, and those near, in numbers; scores by learned weights."""

    def __init__(self, known: Weights) -> None:
        self.weights: dict[str, tuple] = {FORM: ((0.0, 0.0), (0.0, 0.0))}
        self.known, self.all, self.scopes = known, Counter(), [Counter()]

    def add(self, at: Open) -> None:
        if at.scope:
            self.scopes.append(Counter())
        if not at.known:
            self.score(at)
        near = self.scopes[-1]
        for mark in at.own:
            near[mark] += 1
            self.all[mark] += 1

    def score(self, at: Open) -> None:
        """The sums of an element, whose own marks aren't counted yet."""
        up, at.known = at.up, True
        if at.scope:
            at.far, at.home, at.in_form = plus(up.far, up.later), True, False
        else:
            at.near, at.far, at.later = up.near, up.far, up.later
        near = self.scopes[-1]
        for mark in at.own:
            if near.get(mark):
                continue
            if mark not in self.weights:
                self.weights[mark] = self.known.of(f"near {mark}"), self.known.of(f"far {mark}")
            as_near, as_far = self.weights[mark]
            at.near = plus(at.near, as_near)
            if not self.all.get(mark):
                at.later = plus(at.later, as_far)
            at.in_form = at.in_form or mark == FORM

    def remove(self, at: Open) -> None:
        near = self.scopes[-1]
        for mark in at.own:
            near[mark] -= 1
            self.all[mark] -= 1
        if at.scope:
            self.scopes.pop()


def read(page: str, known: Weights | None = None) -> list[Block | str]:
    """Blocks of words and names of tags, in order."""
    out: list[Block | str] = []
    stack, borders = [Open("", frozenset(), None)], [0]  # borders: places of the blocks among them
    open_marks = Marks(known or Weights({}, {}, {}))
    places: dict[str, list[int]] = {}
    now: Block | None = None
    links = forms = 0

    def drop(down: int) -> None:
        nonlocal links
        while len(stack) > down:
            gone = stack.pop()
            places[gone.name].pop()
            open_marks.remove(gone)
            links -= gone.name == "a"
            if borders[-1] == len(stack):
                borders.pop()

    for kind, what, own in tokens(page):
        if kind == "text":
            if what.isspace() and now is None:
                continue
            if now is None:
                now = Block(stack[-1])
                out.append(now)
            text = html.unescape(what) if "&" in what else what
            n = len(text.split())
            now.texts.append(text)
            now.words += n
            now.linked += n if links else 0
            continue
        name = what
        if kind == "start" and name == "br":
            if now is not None:
                now.texts.append(" ")
            continue
        if name in BLOCKS or name in HIDDEN:
            now = now if name in HIDDEN else None
        out.append(name)
        if kind == "end":
            held = places.get(name)
            # a stray end of something inline doesn't reach out of a block
            if held and (name in BLOCKS or held[-1] > borders[-1]):
                drop(held[-1])
            continue
        if name in VOID or name in ("html", "head", "body"):
            continue
        innermost = stack[borders[-1]].name
        if (innermost == "p" and name in ENDS_P) or innermost in CLOSES.get(name, ()):
            drop(borders[-1])
        up = stack[-1]
        same = (name, marks(name, own))
        at = None if name == "form" else up.inside.get(same)
        if at is None:
            at = up.inside[same] = Open(*same, up)
        if name == "form":
            forms, at.form = forms + 1, forms
        places.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            at.block = name
            borders.append(len(stack))
        links += name == "a"
        open_marks.add(at)
        stack.append(at)
    return out


def surface(block: Block) -> list[str]:
    """Features of a block's words: how many there are, whether they are links, and how they end."""
    n, share = block.words, block.linked / max(1, block.words)
    end = "".join(block.texts[-1:]).rstrip()[-1:]
    size = next((k for k, x in enumerate(SIZES) if n <= x), len(SIZES))
    return [f"size {size} of {home(block)}", f"links {0 if not share else 1 if share < 0.5 else 2}", "sentence" if end in ".!?…:;,\"'»”" and end else "open"]


#: Words of blocks of each size.
SIZES = (2, 5, 9, 16, 40)


def home(block: Block) -> str:
    return "article" if block.at.home else "page"


def elements(block: Block, large: set[int]) -> list[str]:
    """Features of the elements around a block; large has the forms that hold most of the page's words and so aren't what forms mostly are."""
    near, far = block.at.around()
    return [home(block), f"in {block.at.block}", *(f"near {m}" for m in near if m != FORM or block.at.form not in large), *(f"far {m}" for m in far if m != FORM)]


class Scorer:
    """Scores of blocks by learned weights, from the sums that reading gave their elements."""

    def __init__(self, known: Weights, large: set[int]) -> None:
        self.known, self.large, self.bases = known, large, {}

    def around(self, block: Block) -> tuple[float, float]:
        """What the elements around a block score, with its words and alone."""
        at = block.at
        kind = at.home, at.block, at.in_form and at.form not in self.large
        if kind not in self.bases:
            form = self.known.of(f"near {FORM}") if kind[2] else NOTHING
            self.bases[kind] = plus(plus(self.known.of(home(block)), self.known.of(f"in {at.block}")), form)
        base = self.bases[kind]
        return base[0] + at.near[0] + at.far[0], base[1] + at.near[1] + at.far[1]

    def judged(self, block: Block) -> tuple[float, bool]:
        """The score of a block, and whether its elements are such as articles have."""
        score, alone = self.around(block)
        blocks = self.known.blocks
        for key in surface(block):
            score += blocks.get(key, 0.0)
        return max(-LOSS, block.words * tanh(score / 2)), alone > 0


def large_forms(own: list[Block | str]) -> set[int]:
    held = Counter()
    for b in own:
        if not isinstance(b, str):
            held[b.at.form] += b.words
    total = held.total()
    return {f for f, n in held.items() if f is not None and 2 * n > total}


RIDGE, STEPS, COMPOSED = 1e-5, 25, 500


def fitted(rows: list[list[str]], labels: list[int], counts: list[int]) -> dict[str, float]:
    """Weights of features by a logistic regression on rows, whose words count less than in proportion."""
    names = sorted({key for r in rows for key in r})
    place = {key: i for i, key in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [place[key] for key in r]] = 1
    y, weight = np.array(labels, float), np.sqrt(np.array(counts, float))
    weight /= weight.sum()
    w = np.zeros(len(names))
    for _ in range(STEPS):  # Newton
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (p - y)) + RIDGE * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(names))
        w -= np.linalg.solve(curve, slope)
    return dict(zip(names, w.tolist(), strict=True))


def learn(pages: list[list[str]]) -> Weights:
    """Weights from labelled pages in parts. Every weight of a tag is below 0."""
    around, words, labels, counts = [], [], [], []
    inside, outside = Counter(), Counter()
    for page in pages:
        by_part = _by_part(page)
        large = large_forms([b for own in by_part for b in own])
        for k, own in enumerate(by_part):
            for b in own:
                if isinstance(b, str):
                    (inside if k % 2 else outside)[b] += 1
                elif b.words:
                    around.append(elements(b, large))
                    words.append(surface(b))
                    labels.append(k % 2)
                    counts.append(b.words)
    total = inside.total() + outside.total()
    # less than a word's score, or paragraphs of one word would be lost at the ends
    tags = {t: -0.01 - 0.1 * (outside[t] + total / 1000) / (inside[t] + outside[t] + total / 500) for t in {*inside, *outside}}
    return Weights(fitted([a + w for a, w in zip(around, words, strict=True)], labels, counts), fitted(around, labels, counts), tags)


def _by_part(page: list[str]) -> list[list[Block | str]]:
    """What read() gives for the whole page, dealt to the page's parts by a mark in the text."""
    own = read("\0".join(page))
    out: list[list[Block | str]] = [[]]
    for b in own:
        if isinstance(b, str):
            out[-1].append(b)
            continue
        texts = "".join(b.texts).split("\0")
        for k, text in enumerate(texts):
            if k:
                out.append([])
            if text.strip():
                part = Block(b.at)
                part.texts, part.words = [text], len(text.split())
                part.linked = min(b.linked, part.words)
                out[-1].append(part)
    return out


@cache
def weights() -> Weights:
    return learn(parts([*LAYOUTS * 3, *composed(COMPOSED)]))


#: What a block inside of an article costs at most, so that a long advert doesn't cut the article in two.
LOSS = 3.0
#: Of a tag that no labelled page has.
UNKNOWN_TAG = -0.06


def main_text(page: str, learned: Weights | None = None) -> str:
    known = learned or weights()
    own = read(page, known)
    scorer = Scorer(known, large_forms(own))
    judged = [(known.tags.get(b, UNKNOWN_TAG), False) if isinstance(b, str) else scorer.judged(b) for b in own]
    start, end = best_region([score for score, _ in judged])
    kept = ("".join(b.texts).split() for b, (_, stays) in zip(own[start:end], judged[start:end], strict=True) if stays)
    return "\n\n".join(" ".join(words) for words in kept if words)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous region with the largest sum, the first and shortest of equal ones; nothing where no sum is over 0."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, found = total, (start, k + 1)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages; no shuffle. The weights are learned once and travel to the tasks."""
    learned = weights()

    def work(batches):
        for batch in batches:
            texts = [main_text(p, learned) for p in batch.column("html").to_pylist()]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return map_batches(own, work, "page_id long, url string, text string, n_chars long")


def op5_subsequence_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op5_subsequence_extract": op5_subsequence_extract}
ORACLE_SQL: dict[str, str] = {}
