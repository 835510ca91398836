"""Main text: pages that the weights haven't seen, hostile pages, odd rows by value."""

import random
import re
import time
from collections import Counter

import pytest

from tracewright.llm import html_text
from tracewright.llm.pages_labelled import LAYOUTS, composed, parts

#: Laid out otherwise than the pages that the weights are learned on.
HELD_OUT = (
    '<div class="layout has-sidebar"><article>[[<h1>{4}</h1><p>{16.} {11.}</p><p>{3.}</p>]]</article><div class=sidebar><p>{15.}</p></div></div>',
    '<div class="page with-menu"><div class=menu><a href=1>{1}</a></div><article>[[<p>{22.}</p><p>{12.}</p>]]</article></div>',
    "<form id=aspnetForm><div class=nav><a href=1>{2}</a></div><article>[[<h1>{3}</h1><p>{17.} {20.}</p><p>{9.}</p>]]</article><div class=footer><p>{8.}</p></div></form>",
    "<header><h2>{2}</h2><nav><a href=1>{1}</a><a href=2>{1}</a></nav></header><main>[[<h1>{5}</h1><p>{19.}</p><h2>{1}</h2><p>{21.}</p>]]<section id=comments><h2>{1}</h2><div class=comment><p>{17.}</p></div></section></main><footer>{6}</footer>",
    "<div class=cookie-banner><p>{15.}</p><button>{1}</button></div><article class=story>[[<h1>{6}</h1><p>{13.} {18.}</p><blockquote>{9.}</blockquote>]]<div class=advertisement>{12.}</div>[[<p>{24.}</p><ul><li>{2}</li><li>{8}</li></ul>]]</article><aside><h3>{2}</h3><a href=1>{4}</a></aside>",
    "<nav><ul><li><a href=1>{1}</a></li></ul></nav><div class=ad>{14.}</div><article>[[<h1>{2}</h1><p><b>{3}</b> {15.}<br><p>{11.} {8.}</p><p>{1.}</p>]]</article><footer>{4}</footer>",
    "<div class=subscribe><h3>{2}</h3><p>{11.}</p></div><article>[[<h1>{4}</h1><p>{15.} <a href=1>{2}</a> {9.}</p><p>{21.}</p>]]<div class=share><a href=1>{1}</a><a href=2>{1}</a></div><div class=related-posts><ul><li><a href=1>{5}</a></li></ul></div></article>",
    "<div class=notice><p>{13.}</p></div><div id=content class=post>[[<h1>{5}</h1><p>{18.} {14.}</p><p>{7.}</p><p>{20.}</p>]]</div><div id=comments><ol><li class=comment><p>{16.}</p></li></ol></div><div id=footer>{5}</div>",
    "<main>[[<article><h1>{3}</h1><p>{14.}</p><table><tr><td>{1}</td><td>{2}</td></tr></table><p>{16.}</p></article>]]</main><div class=newsletter-signup><p>{10.}</p><form><input><button>{1}</button></form></div><div class=popup-overlay><p>{12.}</p></div>",
    "<div class=topbar>{3}</div><div class=article-body>[[<p>{23.} {12.}</p><p>{16.}</p><p>{19.} {10.}</p>]]</div><div class=copyright>{9}</div>",
)


def words(page):
    return [w for p in page[1::2] for w in re.sub("<[^>]*>", " ", p).split()]


def shared(pages):
    both = got_all = want_all = exact = 0
    for page in pages:
        got, want = html_text.main_text("".join(page)).split(), words(page)
        both, got_all, want_all, exact = both + (Counter(got) & Counter(want)).total(), got_all + len(got), want_all + len(want), exact + (got == want)
    return both / got_all, both / want_all, exact


def test_pages_that_the_weights_have_not_seen():
    assert not set(HELD_OUT) & set(LAYOUTS)
    for page in parts(HELD_OUT):
        assert html_text.main_text("".join(page)).split() == words(page), "".join(page)
    right, found, _ = shared(parts(composed(200, seed=99)))
    assert right > 0.96 and found > 0.98


def test_each_labelled_page_by_the_weights_of_the_others():
    own, more = parts(LAYOUTS), parts(composed(300))
    kept = right = 0
    for k in range(0, len(own), 6):
        learned = html_text.learn(own[:k] + own[k + 1 :] + more)
        got, want = html_text.main_text("".join(own[k]), learned).split(), words(own[k])
        both = (Counter(got) & Counter(want)).total()
        kept, right = kept + both / len(want), right + both / len(got)
    assert kept > 0.9 * 6 and right > 0.9 * 6


def test_marks_of_all_elements_count():
    article = "<article><p>{}</p><p>{}</p></article>".format("Some words of the article, which go on for a while.", "And more of them, as long as these.")
    names = " ".join(f"name{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    for around in (f'<div class="{names} sidebar">', '<div class="' + "-".join(["x"] * 30) + '-sidebar">', "".join(f"<div class=q{chr(97 + i % 26)}{chr(97 + i // 26)}>" for i in range(60)) + "<div class=sidebar>"):
        assert html_text.main_text(article + around + "<p>What stands beside the article isn't a part of it.</p></div>") == "Some words of the article, which go on for a while.\n\nAnd more of them, as long as these."


def test_links_and_lists_of_an_article_stay():
    page = (
        "<nav><ul><li><a href=1>Home</a></li></ul></nav><article><p>The first paragraph has some words that go on for a while.</p><p><a href=1>A paragraph that is one link</a></p><p>More words follow here, and then a list of sources.</p>"
        "<ul><li><a href=2>One source</a></li><li><a href=3>Other</a></li></ul><p>Yes</p><div class=advertisement><p>Buy this thing now, it is very good and very cheap.</p></div><p>The last paragraph ends the article with some more words.</p></article><footer>About</footer>"
    )
    assert html_text.main_text(page).split("\n\n") == [
        "The first paragraph has some words that go on for a while.", "A paragraph that is one link", "More words follow here, and then a list of sources.", "One source", "Other", "Yes", "The last paragraph ends the article with some more words.",
    ]


def test_scan_equals_the_best_of_all_regions():
    rng = random.Random(6)
    for _ in range(1000):
        scores = [rng.choice((-3, -2, -1, -0.5, 0, 0.5, 1, 2, 3)) for _ in range(rng.randint(0, 30))]
        regions = [(sum(scores[i:j]), -i, -j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        start, end = html_text.best_region(scores)
        best = max((r[0] for r in regions), default=0)
        assert (end == start) == (best <= 0) and sum(scores[start:end]) == max(best, 0)


def test_sums_of_elements_equal_those_of_their_features():
    known = html_text.weights()
    pages = ["".join(p) for p in parts([*HELD_OUT, *LAYOUTS])] + ["<form class=a><p>x y</p><main class='b post'><form><p>k</p></form><article class='b c'><div class=c>z</div><main>w</main></article>v</main></form>u"]
    for page in pages:
        own = html_text.read(page, known)
        large = html_text.large_forms(own)
        scorer = html_text.Scorer(known, large)
        for b in own:
            if not isinstance(b, str):
                want = [sum(w.get(k, 0.0) for k in html_text.elements(b, large)) for w in (known.blocks, known.elements)]
                assert all(abs(x - y) < 1e-9 for x, y in zip(scorer.around(b), want, strict=True))


N = 1 << 20
HOSTILE = {
    "quotes": "<p>hello</p><a " + "\"'" * (N // 2), "open tags": "<a " * (N // 3), "open scripts": "<script " * (N // 8), "unclosed scripts": "<script>" * (N // 8), "unclosed templates": "<template>" * (N // 10),
    "nested": "<div>" * 100_000 + "</b>" * 100_000, "inline in blocks": "<i><div>" + "<b>" * 150_000 + "</i>" * 150_000, "comments": "<!--" * (N // 4), "comment ends": "<!-- --!" * (N // 8), "less": "<" * N,
    "attributes": "<a " + "b=c " * (N // 4) + ">x</a>", "classes": "<div class='" + "ad " * (N // 3) + "'>x</div>", "entities": "&amp" * (N // 4), "spaces": "<a" + " " * N, "equals": "<a" + "=" * N, "paragraphs": "<p>a" * (N // 4),
    "items": "<li><ul>" * (N // 8), "closing": "</" * (N // 2), "no end": "<svg" * (N // 4), "mixed": "<svg>a</svg ><template><math>" * (N // 30), "articles": "<div class='" + "".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " for i in range(676)) + "'>" + "<article>a</article>" * (N // 24), "articles nested": "<article class=ab>" * (N // 20), "classes nested": "".join(f"<div class=a{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}>" for i in range(40_000)),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_time_by_their_length(name):
    html_text.weights()
    took = []
    for page in (HOSTILE[name][: N // 4], HOSTILE[name]):
        began = time.perf_counter()
        html_text.main_text(page)
        took.append(time.perf_counter() - began)
    # four times the text; a square would take 16 times, and by far longer than this
    assert took[1] < max(10 * took[0], 0.5) and took[1] < 8, took


@pytest.mark.parametrize("page, want", [
    ("", ""), ("<nav>a b</nav>", ""), ("<article>a&amp;b &lt; c &eacute;&nbsp;d</article>", "a&b < c é d"), ("<article><p>One  two\n three</p><p>Four.</p></article>", "One two three\n\nFour."),
    ("<article><p>One<br>two<br/>three</p></article>", "One two three"), ("<article><p>a<b>b</b>c < d</p><script>var x='</p>'</script><style>p{}</style><!-- no --><p>e</p></article>", "abc < d\n\ne"),
    ("<ARTICLE><P>Loud words here<P>And here</ARTICLE>", "Loud words here\n\nAnd here"), ("<article><p>kept words</p></article><script>never closed", "kept words"), ("<article><p>kept words</p><a href='never closed", "kept words"),
    ("<article><p>un<i>closed</p><p>next</i> one</p></article>", "unclosed\n\nnext one"), ("plain words without any tag at all, but quite a lot of them, which makes them a text that somebody has written down.", "plain words without any tag at all, but quite a lot of them, which makes them a text that somebody has written down."),
])
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_odd_rows_by_value(spark):
    page = "<nav><a href=1>x</a></nav><article><p>Some words of a page.</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "w", ""), (4, None, "<article>" + "<p>More and more words.</p>" * 5000 + "</article>")]
    given = spark.createDataFrame([(*r, "text", 5, "key") for r in rows], "page_id long, url string, html string, text string, n_chars long, key string")
    got = sorted((tuple(r) for r in html_text.extract(given).collect()), key=str)
    text = "Some words of a page."
    long = "\n\n".join(["More and more words."] * 5000)
    assert got == sorted([(1, "u", text, 21), (1, "u", text, 21), (None, None, text, 21), (2, "v", "", 0), (3, "w", "", 0), (4, None, long, len(long))], key=str)
    assert html_text.extract(given.limit(0)).count() == 0
