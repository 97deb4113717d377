"""Hand-written labelled pages: layouts with marked places for main text and for everything else.

In a layout ``{H}``, ``{P}`` and ``{I}`` are main text (heading, paragraph, item), ``{j}`` and ``{J}`` are other text (a few
words, sentences).  ``[[...]]`` repeats two to six times, ``((...))`` is there in half of the pages.
"""

from __future__ import annotations

import random
import re

LAYOUTS = (
    # Semantic elements.
    '<header><a href="/">{j}</a><p>{j}</p></header><nav><ul>[[<li><a href="#">{j}</a></li>]]</ul></nav>((<div class="ad">{J}</div>))'
    '<article><h1>{H}</h1>[[<p>{P}</p>]]</article><aside><h3>{j}</h3>[[<p>{J}</p>]]</aside><footer>&copy; {j} {J}</footer>',
    '<nav><ul>[[<li><a href="/x">{j}</a></li>]]</ul></nav><!-- x --><div class="ad">{J}</div><article><h1>{H}</h1>'
    '<p><b>{P}<br>[[<p>{P}</p>]]((<p><b>{P}<br>))</article><footer>&copy; {j} &middot; {J}</footer>',
    '<nav><ul>[[<li><a href="/x">{j}</a></li>]]</ul></nav><article><h1>{H}</h1><p>{P}<br></article><footer>&copy; {j} &middot; {J}</footer>',
    '<nav>[[<a href="/x">{j}</a>]]</nav><main><article><h1>{H}</h1><p>{P}</p><div class="advert">{J}</div>[[<p>{P}</p>]]'
    '<section class="comments"><h2>{j}</h2>[[<div class="comment"><b>{j}</b><p>{J}</p></div>]]</section></article></main><footer><p>{J}</p></footer>',
    '<header class="site-header"><h1><a href="/">{j}</a></h1><p>{J}</p></header><main><h1>{H}</h1><p>{P}</p><h2>{H}</h2>[[<p>{P}</p>]]'
    '<ul>[[<li>{I}</li>]]</ul><p>{P}</p></main><aside class="sidebar"><ul>[[<li><a href="#">{j}</a></li>]]</ul><p>{J}</p></aside><footer>{J}</footer>',
    '<div class="cookie-notice"><p>{J}</p><a href="#">{j}</a></div><article><header><h1>{H}</h1></header>[[<p>{P}</p>]]'
    '<form action="/s"><p>{J}</p><label>{j}</label><input name="e"></form>[[<p>{P}</p>]]<footer><p>{J}</p></footer></article>'
    '<section id="comments"><h3>{j}</h3><ol class="commentlist">[[<li><p>{J}</p><p>{J}</p></li>]]</ol></section>',
    '<article><h1>{H}</h1>[[<p>{P}</p>]]<aside class="related"><h4>{j}</h4><ul>[[<li><a href="#">{j}</a></li>]]</ul></aside>[[<p>{P}</p>]]'
    '<blockquote>{P}</blockquote><p>{P}</p></article>[[<article class="comment"><h4>{j}</h4><p>{J}</p></article>]]<footer>{j}</footer>',
    '<div role="banner">{j} {J}</div><div role="navigation">[[<a href="#">{j}</a>]]</div><div role="main"><h1>{H}</h1>[[<p>{P}</p>]]</div>'
    '<div role="complementary"><p>{J}</p></div><div role="contentinfo" class="footer"><p>{J}</p></div>',
    '<dialog class="modal"><p>{J}</p></dialog><section class="content"><h1>{H}</h1><figure><img src="x"><figcaption>{I}</figcaption></figure>'
    '[[<p>{P}</p>]]<ol>[[<li>{I}</li>]]</ol><dl>[[<dt>{I}</dt><dd>{P}</dd>]]</dl></section><section class="newsletter"><h3>{j}</h3><p>{J}</p></section>',
    # Boxes named by class or id.
    '<div id="header"><div class="logo">{j}</div><p>{J}</p></div><div id="menu"><ul>[[<li><a href="#">{j}</a></li>]]</ul></div>'
    '<div id="content"><h1>{H}</h1>[[<p>{P}</p>]]<h2>{H}</h2>[[<p>{P}</p>]]</div><div id="sidebar">[[<div class="widget"><h3>{j}</h3><p>{J}</p></div>]]</div>'
    '<div id="footer"><p>{J}</p><p>&copy; {j}</p></div>',
    '<div class="topbar">[[<a href="#">{j}</a>]]</div><div class="post"><h2>{H}</h2><div class="entry-content">[[<p>{P}</p>]]'
    '<div class="ad-slot"><p>{J}</p></div>[[<p>{P}</p>]]</div><div class="share">[[<a href="#">{j}</a>]]</div></div>'
    '<div class="comments-area">[[<div class="comment-body"><p>{J}</p></div>]]<div class="reply"><form><p>{j}</p></form></div></div>'
    '<div class="site-footer">{J}</div>',
    '<div class="alert">{J}</div><div class="wrapper"><div class="navbar"><ul>[[<li><a href="#">{j}</a></li>]]</ul></div><div class="story">'
    '<h1>{H}</h1>[[<div class="paragraph">{P}</div>]]</div><div class="sponsored"><h4>{j}</h4><p>{J}</p></div>'
    '<div class="search"><form><span>{j}</span></form></div></div><div class="copyright">{J}</div>',
    '<div class="breadcrumb"><a href="#">{j}</a> &gt; <a href="#">{j}</a></div><div class="article-body"><h1>{H}</h1><p>{P}</p><ul>[[<li>{I}</li>]]</ul>'
    '<pre>{P}</pre><p>{P}</p><table>[[<tr><td>{I}</td><td>{I}</td></tr>]]</table></div><div class="promo">[[<p>{J}</p>]]</div>'
    '<div class="reader-comments">[[<blockquote>{J}</blockquote>]]</div>',
    # Nothing named: lengths, links and places tell.
    '<div>[[<a href="#">{j}</a> ]]</div><div><h1>{H}</h1>[[<p>{P}</p>]]</div><div><ul>[[<li><a href="#">{j}</a></li>]]</ul></div><div>&copy; {j}</div>',
    '<h1>{H}</h1>[[<p>{P}</p>]]<h2>{H}</h2>[[<p>{P}</p>]]<hr><p>&copy; {j}</p>',
    '<p>[[<a href="#">{j}</a> ]]</p><h2>{H}</h2>[[<p>{P}]]<ul>[[<li>{I}]]</ul><p>{P}<p><a href="#">{j}</a> <a href="#">{j}</a>',
    '<table><tr><td>[[<a href="#">{j}</a><br>]]</td><td><h1>{H}</h1>[[<p>{P}</p>]]</td></tr><tr><td>&copy; {j}</td></tr></table>',
    '<h1>{H}</h1><p>{P}</p>', '<article><h1>{H}</h1></article><footer>&copy; {J}</footer>', '<div>{P}</div>', '<p>{P}</p>[[<p>{P}</p>]]',
    '<nav>[[<a href="#">{j}</a>]]</nav><footer><p>{J}</p></footer>',
)
_MARK = re.compile(r"\{([HPIjJ])\}")
_SIGNS = ("", "", "", " &amp; more", " &quot;so&quot;", " <b>bold</b>", ' <a href="#">link</a>', " <i>then</i>")


def _words(rng: random.Random, least: int, most: int) -> str:
    syllables = ("ta", "re", "no", "li", "mu", "e", "sto", "ven", "ra", "qui", "é", "ü", "on", "the", "ing")
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(least, most)))


def _sentences(rng: random.Random, most: int) -> str:
    return " ".join(_words(rng, 2, 18).capitalize() + rng.choice(("", "", rng.choice(_SIGNS))) + "." for _ in range(rng.randint(1, most)))


def _plain(source: str) -> str:
    text = re.sub(r"<[^>]*>", "", source).replace("&amp;", "&").replace("&quot;", '"')
    return " ".join(text.split())


def fill(layout: str, rng: random.Random) -> tuple[str, str]:
    """(html, main text) of a layout with its choices and places filled in."""
    while "[[" in layout or "((" in layout:
        layout = re.sub(r"\[\[((?:(?!\[\[|\]\]).)*)\]\]", lambda m: m[1] * rng.randint(2, 6), layout)
        layout = re.sub(r"\(\(((?:(?!\(\(|\)\)).)*)\)\)", lambda m: m[1] if rng.random() < 0.5 else "", layout)
    lines = []

    def put(m: re.Match) -> str:
        kind = m[1]
        text = {"H": lambda: _words(rng, 1, 12), "P": lambda: _sentences(rng, rng.choice((1, 2, 8))), "I": lambda: _words(rng, 1, 15),
                "j": lambda: _words(rng, 1, 4), "J": lambda: _sentences(rng, rng.choice((1, 1, 2, 5)))}[kind]()
        if kind in "HPI":
            lines.append(_plain(text))
        return text

    body = _MARK.sub(put, layout)
    head = '<!DOCTYPE html><html lang="x"><head><meta charset="utf-8"><title>t</title><style>p{margin:0}</style></head><body>'
    return head + body + rng.choice(("</body></html>", "")), "\n".join(lines)


def labelled_pages(each: int = 8, seed: int = 11) -> list[tuple[str, str]]:
    """(html, text): every layout filled ``each`` times."""
    rng = random.Random(seed)
    return [fill(layout, rng) for layout in LAYOUTS for _ in range(each)]
