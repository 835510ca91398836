"""Pages labelled by hand, from which html_text learns its weights.

What stands between [[ and ]] is the main text. {n} stands for n invented words and {n.} for a sentence of n words: only
where words stand is learned, never which words they are. The layouts are invented, after common habits of page makers.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence
from itertools import cycle

WORDS = "ver tamil oste brenta kul sorrel ammin dask pellow ingra fent lorum haskel viden orta quill besk tarn umber yole".split()

LAYOUTS = (
    "<nav><ul><li><a href=a>{1}</a></li><li><a href=b>{1}</a></li></ul></nav><article>[[<h1>{5}</h1><p>{16.}</p><p>{22.} {9.}</p><p>{4.}</p>]]</article><footer>{5}</footer>",
    "<header><div class=logo>{2}</div><a href=x>{2}</a></header><main>[[<h1>{4}</h1><p>{14.} {18.}</p>]]<aside><h3>{1}</h3><ul><li><a href=1>{3}</a><li><a href=2>{4}</a></ul></aside>[[<h2>{4}</h2><p>{17.}</p><p>{25.}</p>]]</main><footer><p>{2}</p><p>{12.}</p></footer>",
    "<div id=top><a href=1>{1}</a> | <a href=2>{1}</a> | <a href=3>{2}</a></div><div class=content>[[<h1>{4}</h1><p>{21.} {14.}</p><ul><li>{7}</li><li>{3}</li><li>{11}</li></ul><p>{13.}</p>]]</div><div class=comments><h3>{1}</h3><p>{11.}</p><p>{24.} {8.}</p></div><div>{2}</div>",
    "<table><tr><td><a href=1>{1}</a><br><a href=2>{2}</a><br><a href=3>{1}</a></td><td>[[<p>{20.} {15.}</p><p>{18.}</p><p>{26.}</p>]]</td></tr></table><p><a href=m>{1}</a></p>",
    "<div class=cookie-notice>{10.} <button>{1}</button></div><div class=ad>{15.}</div><article class=post>[[<h2>{3}</h2><p>{14.}</p><blockquote>{5.}</blockquote><p>{19.}</p>]]<div class=share><a href=1>{1}</a><a href=2>{1}</a></div></article><div class=sidebar><h4>{1}</h4><a href=1>{4}</a><p>{16.}</p></div>",
    "<form action=s><input name=q><button>{1}</button></form><div><div>[[<p>{18.}</p><p>{5.}</p><p>{20.} {14.}</p><h2>{3}</h2><p>{23.}</p>]]</div></div><div><a href=1>{1}</a> <a href=2>{1}</a></div>",
    "<div class='wrap has-sidebar'><article>[[<h1>{6}</h1><p>{15.} {9.}</p><p>{28.}</p>]]</article><div class=sidebar><h3>{2}</h3><p>{14.}</p><ul><li><a href=1>{5}</a></li><li><a href=2>{6}</a></li></ul></div></div><footer class=site-footer><p>{9.}</p></footer>",
    "<form id=page method=post><div class=menu><a href=1>{1}</a><a href=2>{1}</a></div><div class=main-content>[[<h1>{4}</h1><p>{24.}</p><p>{17.} {12.}</p><p>{21.}</p><p>{19.}</p>]]</div><div class=newsletter><label>{2}</label><p>{11.}</p><input><button>{1}</button></div></form>",
    "<header class=masthead><h2>{2}</h2><p>{6}</p></header><div class=banner>{13.}</div><section class=story>[[<h1>{7}</h1><p>{20.}</p><p>{12.} {16.}</p><figure><img src=a><figcaption>{8}</figcaption></figure><p>{25.}</p>]]</section><section class=related><h3>{2}</h3><div><a href=1>{6}</a><p>{12.}</p></div><div><a href=2>{5}</a><p>{14.}</p></div></section><footer><ul><li><a href=1>{2}</a></li></ul></footer>",
    "<div id=header><div id=nav><a href=1>{1}</a><a href=2>{2}</a></div></div><div id=content>[[<h1>{5}</h1><h2>{3}</h2><p>{17.}</p><h2>{4}</h2><p>{21.} {8.}</p><h3>{2}</h3><p>{15.}</p>]]</div><div id=footer><p>{14.}</p></div>",
    "<div class='alert notice'><p>{12.}</p></div><article>[[<h1>{4}</h1><p>{18.}</p><ol><li>{9.}</li><li>{12.}</li><li>{6.}</li></ol><p>{14.}</p>]]<section class=comments><h2>{2}</h2><div class=comment><b>{1}</b><p>{13.} {16.}</p></div><div class=comment><b>{1}</b><p>{22.}</p></div></section></article><footer>{7.}</footer>",
    "<nav class=breadcrumb><a href=1>{1}</a> / <a href=2>{1}</a> / {3}</nav><main>[[<p>{22.}</p><p>{14.} {17.}</p>]]<div class=advertisement><p>{14.} {9.}</p></div>[[<p>{19.}</p><p>{23.}</p>]]<div class=promo><p>{12.}</p></div>[[<p>{16.}</p>]]</main><div class=popup><p>{13.}</p><button>{1}</button></div>",
    "<div class=page><div class=nav-menu><ul><li>{1}</li><li>{2}</li><li>{1}</li></ul></div><div class=text>[[<p>{27.}</p><p>{15.} {11.}</p><table><tr><th>{1}</th><th>{2}</th></tr><tr><td>{2}</td><td>{3}</td></tr></table><p>{18.}</p>]]</div><div class=copyright>{8}</div></div>",
    "<div class=consent><h2>{3}</h2><p>{21.} {14.}</p><button>{2}</button><button>{1}</button></div><div class=article>[[<h1>{5}</h1><div class=byline>{4}</div><p>{16.}</p><p>{24.} {10.}</p>]]</div><div class=reader-comments><div class=reply><p>{15.}</p></div><div class=reply><p>{9.} {13.}</p></div></div>",
    "<div class=topbar><span>{2}</span><a href=1>{2}</a></div><div class=post><h1>[[{6}]]</h1><div class=entry>[[<p>{14.} {20.}</p><p>{13.}</p><pre>{9}</pre><p>{17.}</p>]]</div><div class=tags><a href=1>{1}</a><a href=2>{1}</a></div></div><div class=widget><h3>{2}</h3><p>{15.}</p></div><div class=footer>{5} <a href=1>{1}</a></div>",
    "<aside class=left><p>{13.}</p><a href=1>{2}</a></aside><article>[[<header><h1>{4}</h1><p>{9}</p></header><p>{18.} {12.}</p><p>{22.}</p>]]<footer><a href=1>{2}</a><a href=2>{3}</a></footer></article><aside><h3>{2}</h3><p>{17.}</p></aside>",
    "<div><p>{2}</p></div>[[<h1>{5}</h1><p>{19.}</p><p>{23.} {8.}</p><dl><dt>{2}</dt><dd>{12.}</dd><dt>{1}</dt><dd>{15.}</dd></dl>]]<hr><p><a href=1>{2}</a> <a href=2>{2}</a></p>",
    "<div role=navigation><a href=1>{2}</a><a href=2>{1}</a></div><div role=main>[[<h1>{3}</h1><p>{15.}</p><p>{26.}</p><p>{7.}</p>]]</div><div role=complementary><h3>{2}</h3><p>{18.}</p></div><div role=contentinfo><p>{11.}</p></div>",
    "<div class=modal><div class=signup><h3>{4}</h3><p>{14.}</p><form><input><button>{2}</button></form></div></div><div class=content-body>[[<p>{20.} {13.}</p><p>{17.}</p><p>{9.} {21.}</p>]]</div><ul class=pagination><li><a href=1>{1}</a></li><li><a href=2>{1}</a></li></ul>",
    "<div class=sponsored><h4>{3}</h4><p>{16.}</p></div><div id=article-text>[[<h1>{6}</h1><p>{12.} {19.}</p><p>{24.}</p><ul><li>{4}</li><li>{5}</li></ul>]]</div><div class=recommended><ul><li><a href=1>{6}</a></li><li><a href=2>{7}</a></li></ul></div><div class=social><a href=1>{1}</a> <a href=2>{1}</a></div>",
    "<div class='layout with-menu'><div class=menu><ul><li><a href=1>{1}</a><ul><li><a href=2>{2}</a></li></ul></li></ul></div><main class=with-ads>[[<h1>{4}</h1><p>{21.}</p><p>{14.}</p>]]<div class=ads>{11.} {13.}</div>[[<p>{18.}</p>]]</main></div><footer>{4}</footer>",
    "<h1>{2}</h1><p><a href=1>{1}</a> <a href=2>{1}</a> <a href=3>{2}</a></p><div><h2>[[{4}]]</h2>[[<p>{16.} {22.}</p><p>{13.}</p><p>{25.}</p>]]</div><div class=disclaimer><p>{20.}</p></div><div class=discussion><p>{14.}</p><p>{19.}</p></div>",
    "<section class=hero><h2>{3}</h2><p>{7}</p><a href=1>{2}</a></section><article class=entry-content>[[<p>{17.}</p><p>{23.} {9.}</p><h3>{3}</h3><p>{15.}</p>]]<div class=author-box><p>{14.}</p></div><div id=respond class=comment-form><h3>{3}</h3><label>{1}</label><textarea></textarea><p>{9.}</p></div></article>",
    "<table class=menu><tr><td>{1}</td><td>{1}</td><td>{1}</td></tr></table><center>[[<h2>{4}</h2>]]</center>[[<p>{18.} {20.}</p><p>{15.}</p><p>{22.}</p>]]<table class=footer><tr><td>{4}</td><td><a href=1>{2}</a></td></tr></table>",
    "<div class=login><form><label>{1}</label><input><label>{1}</label><input><button>{2}</button></form></div><div class=body>[[<h1>{5}</h1>{24.} {15.}<br><br>{19.}<br><br>{22.}]]</div><div class=legal>{14.} {10.}</div>",
    "<nav>{1} {1} {2}</nav><div class=notices><p>{17.}</p></div><main>[[<article><h2>{4}</h2><p>{15.} {12.}</p></article><article><h2>{3}</h2><p>{21.}</p></article>]]</main><footer><small>{6}</small><p>{16.}</p></footer>",
    "<div class=gdpr><p>{24.}</p></div><div class=container><div class=row><div class=col>[[<h1>{5}</h1><p>{13.}</p><p>{19.} {16.}</p><blockquote><p>{12.}</p></blockquote><p>{8.}</p>]]</div><div class=col><div class=advert><p>{13.}</p></div><div class=trending><h3>{1}</h3><a href=1>{5}</a><a href=2>{6}</a></div></div></div></div>",
    "<div class=skip><a href=1>{3}</a></div><header><nav><a href=1>{1}</a><a href=2>{1}</a></nav><p>{8.}</p></header><article>[[<p>{16.}</p><h2>{2}</h2><p>{20.}</p><p>{14.} {18.}</p>]]<aside class=related><h4>{2}</h4><p>{13.}</p><a href=1>{4}</a></aside>[[<p>{15.}</p>]]</article><div class=subscribe><p>{12.}</p><form><input><button>{1}</button></form></div>",
    "<div class=header><p>{7.}</p></div><div class=blog-post>[[<h2>{5}</h2><p>{17.} {13.}</p><p>{21.}</p>]]<p class=share-links><a href=1>{2}</a> <a href=2>{2}</a></p></div><ol class=commentlist><li class=comment><cite>{2}</cite><p>{18.}</p></li><li class=comment><cite>{1}</cite><p>{11.} {14.}</p></li></ol>",
    "<div id=ad-top><p>{14.}</p></div><div id=main><div id=story>[[<h1>{4}</h1><p>{22.}</p><p>{16.} {11.}</p><p>{18.}</p>]]</div><div id=sidebar><div class=ad>{12.}</div><h3>{2}</h3><p>{15.}</p></div></div><div id=disqus_thread><p>{13.}</p><p>{20.}</p></div>",
    "<dialog><p>{11.}</p><button>{1}</button></dialog><main id=content>[[<h1>{3}</h1><p>{14.}</p><p>{27.} {8.}</p><details><summary>{3}</summary><p>{16.}</p></details>]]</main><nav class=pager><a href=1>{1}</a><a href=2>{1}</a></nav><footer><nav><a href=1>{2}</a><a href=2>{2}</a></nav><p>{10}</p></footer>",
    "<div>{3}</div><div><div><a href=1>{2}</a></div><div><a href=2>{2}</a></div></div><div><div>[[<h1>{5}</h1><div>{24.} {19.}</div><div>{21.} {12.}</div><div>{16.}</div>]]</div><div><div><a href=1>{5}</a></div><div><a href=2>{4}</a></div></div></div><div>{6}</div>",
    "<article>[[<h1>{4}</h1><p>{19.}<p>{13.} {15.}<p>{22.}<ul><li>{5}<li>{7}<li>{4}</ul><p>{17.}]]</article><section id=comments><h2>{1}</h2><article class=comment><header>{2}</header><p>{16.}</p></article><article class=comment><header>{2}</header><p>{21.}</p></article></section>",
    "<div class=premium-banner><p>{13.}</p></div><div class=page-content>[[<p>{15.} {12.}</p><p>{20.}</p>]]<div class=inline-ad><p>{16.}</p></div>[[<p>{18.}</p><p>{14.}</p>]]<div class=promotion><h4>{3}</h4><p>{12.}</p></div></div><aside class=sidebar><p>{19.}</p></aside><div class=site-info>{6}</div>",
    "<form class=search-form><label>{2}</label><input></form><form class=contact><p>{10.}</p><label>{1}</label><input><textarea></textarea><button>{1}</button></form><article class=text>[[<h1>{3}</h1><p>{20.}</p><p>{16.} {22.}</p><p>{12.}</p>]]</article><div class=cookie-bar><p>{15.}</p></div><div class=feedback><p>{9.}</p><button>{1}</button></div>",
    "<div class=main>[[<h1>{5}</h1><p>{16.}</p>]]<div class=box><h4>{2}</h4><ul><li><a href=1>{3}</a></li><li><a href=2>{4}</a></li></ul></div>[[<p>{23.}</p><p>{18.} <a href=3>{2}</a> {6.}</p><p><a href=4>{3}</a> {14.}</p>]]</div><div class=bottom><a href=1>{1}</a><a href=2>{1}</a>{4}</div>",
)


#: Names that page makers give to what isn't the article, and to what holds it.
ASIDE = "ad ads advert advertisement adsense sponsor sponsored promo promotion banner comment comments replies reply respond discussion disqus sidebar side menu navbar nav navigation topnav breadcrumb breadcrumbs footer foot header masthead topbar cookie cookies consent gdpr privacy notice alert popup modal overlay share sharing social related recommended recommendations trending popular widget newsletter subscribe subscription signup login search pager pagination toolbar copyright legal disclaimer skip teaser feedback survey donate rating cart".split()
HOLDS = "article content main post entry story body text page-content article-body post-content entry-content main-text blog-post".split()
#: What stands in such elements, and parts of articles.
INSIDE_ASIDE = (
    "{14.}", "<p>{13.}</p>", "<p>{24.}</p><p>{9.} {12.}</p>", "<h3>{2}</h3><p>{15.}</p>", "<h4>{1}</h4><ul><li><a href=1>{4}</a></li><li><a href=2>{5}</a></li></ul>", "<a href=1>{2}</a> <a href=2>{1}</a>", "{3}", "<ul><li>{1}</li><li>{2}</li></ul>",
    "<b>{1}</b><p>{11.} {17.}</p>", "<div><a href=1>{5}</a><p>{14.}</p></div>", "<p>{12.}</p><button>{1}</button>", "<label>{1}</label><input><p>{8.}</p>", "<ol><li><p>{16.}</p></li><li><p>{10.} {21.}</p></li></ol>", "<span>{6}</span>",
)
OF_ARTICLES = (
    "<p>{18.}</p>", "<p>{22.} {13.}</p>", "<p>{9.}</p>", "<p>{27.} {16.} {11.}</p>", "<h2>{3}</h2><p>{17.}</p>", "<ul><li>{4}</li><li>{9}</li><li>{6}</li></ul>", "<p>{12.} <a href=1>{2}</a> {8.}</p>", "<blockquote><p>{14.}</p></blockquote>", "<ol><li>{11.}</li><li>{7.}</li></ol>",
    "<p><b>{2}</b> {15.}</p>", "<h3>{2}</h3><p>{21.}<br>{13.}</p>", "<table><tr><th>{1}</th><th>{1}</th></tr><tr><td>{2}</td><td>{3}</td></tr></table>", "<p>{5.}</p>", "<figure><img src=1><figcaption>{8.}</figcaption></figure>", "<pre>{8}</pre><p>{14.}</p>", "<div>{19.} {12.}</div>", "<section><h2>{4}</h2><p>{20.}</p></section>",
    "<p>{1.}</p>", "<p>{2}</p>", "<p>{3.}</p>", "<h2>{1}</h2><p>{13.}</p>", "<h2>{2}</h2><p>{15.}</p>", "<ul><li>{1}</li><li>{2}</li><li>{1}</li></ul>", "<p>{6.}</p>", "<h3>{1}</h3><ul><li>{12.}</li><li>{15.} {8.}</li></ul>",
)


def composed(n: int, seed: int = 7) -> list[str]:
    """Layouts put together at random from the parts above, the parts of articles marked as main text."""
    rng = random.Random(seed)

    def box() -> str:
        inside = rng.choice(INSIDE_ASIDE)
        if rng.random() < 0.3:
            name = rng.choice(("nav", "footer", "aside", "header", "form", "dialog"))
            return f"<{name}>{inside}</{name}>"
        name, key = rng.choice(("div", "div", "div", "section", "aside")), rng.choice(("class", "class", "id", "role"))
        words = [rng.choice(ASIDE)] + [rng.choice(("box", "block", "wrap", "inner", "list", "item", "area"))] * (rng.random() < 0.3)
        rng.shuffle(words)
        return f"<{name} {key}={'-'.join(words)}>{inside}</{name}>"

    def boxes(most: int) -> str:
        return "".join(box() for _ in range(rng.randint(0, most)))

    out = []
    for _ in range(n):
        body = ["[[" + f"<h1>{{{rng.randint(1, 8)}}}</h1>" * (rng.random() < 0.7)]
        for _ in range(rng.randint(2, 7)):
            body.append(rng.choice(OF_ARTICLES))
            if rng.random() < 0.2:
                body.append(f"]]{box()}[[")
        body.append(rng.choice(("<p>{24.}</p>", "<p>{15.} {19.}</p>")) + "]]" + boxes(1))
        page = "".join(body)
        for _ in range(rng.randint(0, 2)):
            page = f"<div class={rng.choice(('wrap', 'row', 'col', 'inner', 'container', 'box', 'block'))}>{page}{box() if rng.random() < 0.2 else ''}</div>"
        kind = rng.random()
        if kind < 0.35:
            page = f"<article>{page}</article>"
        elif kind < 0.5:
            page = f"<main>{page}</main>"
        elif kind < 0.8:
            page = f"<{rng.choice(('div', 'section', 'td', 'div'))} {rng.choice(('class', 'id'))}={rng.choice(HOLDS)}>{page}"
        page = boxes(3) + page + boxes(4)
        if rng.random() < 0.2:
            page = f"<div class='{rng.choice(HOLDS)}-wrap'>{page}</div>"
        out.append(page if rng.random() > 0.05 else f"<form id=page>{page}</form>")
    return out


def parts(layouts: Sequence[str]) -> list[list[str]]:
    """Each page in parts, of which the second, fourth and so on are main text."""
    own = cycle(WORDS)

    def said(m: re.Match) -> str:
        words = " ".join(next(own) for _ in range(int(m[1])))
        return words.capitalize() + "." if m[2] else words

    return [re.split(r"\[\[|\]\]", re.sub(r"\{(\d+)(\.?)\}", said, page)) for page in layouts]
