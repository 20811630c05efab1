"""Page shapes with the text that a reader would take for the article, and markup made to hurt."""

import time

import pytest

from lakesearch.llm import html_text

LINE = "It is the story of a man who was in the town and had not been there before that day with his wife."
HEAD, BODY = "<h1>Title of it</h1>", f"<p>{LINE}</p>" * 4
ART, TEXT = HEAD + BODY, "\n\n".join(["Title of it", *[LINE] * 4])
REMARK = "This is what I think of it and it was not that good for me in the end, but you can not have it all. " * 3
MENU = '<ul><li><a href="/">Home</a><li><a href="/n">The news of the day</a></ul>'

SHAPES = {
    "plain article": f"<article>{ART}</article>",
    "marks on body": f'<body class="post right-sidebar"><nav>{MENU}</nav><article>{ART}</article></body>',
    "marks on main": f'<main class="search-results">{ART}</main>',
    "marks on article": f'<article class="post category-social share">{ART}</article>',
    "another attribute": f'<article data-role="share" aria-class="ad">{ART}</article>',
    "absent comments": f'<div class="post no-comments comments-closed"><article>{ART}</article></div>',
    "form around the page": f'<form id="aspnetForm" action="x"><div class="menu">{MENU}</div><article>{ART}</article></form>',
    "form around divs": f'<form method="post"><div id="page">{ART}</div></form>',
    "layout called after its sidebar": f'<div class="wrap sidebar">{ART}<div class="sidebar"><p>The best of all that is on the web and in the town of the week for you and me to see.</p></div></div>',
    "nested layouts": f'<div class="page social"><div class="widget"><div class="content promo">{ART}</div></div><div class="ad">{LINE}</div></div>',
    "button without end": f"<button>Menu<article>{ART}</article>",
    "button without end, others with": f"<div><button>Menu<div>{ART}</div></div><div><button>ok</button></div>",
    "button ends with its parent": f'<div class="search"><button>Go</div>{ART}<button>ok</button>',
    "apostrophe in a bare value": f"<article title=it's>{ART}</article>",
    "quote without end": f'<div><a href="x>y</a></div><article>{ART}</article>',
    "head without end": f"<html><head><title>x</title><meta name=a><body><article>{ART}</article>",
    "head and body left out": f"<title>x</title><article>{ART}</article>",
    "empty svg": f'<article>{HEAD}<svg viewBox="0" />{BODY}<svg><path d="1"/></svg></article>',
    "iframe without end": f"<iframe src=x><article>{ART}</article>",
    "select without ends": f"<select><option>a<option>b<article>{ART}</article>",
    "noscript without end": f"<noscript>x<article>{ART}</article>",
    "script with markup": f"<script>var t = '<article><p>{LINE}</p>';</script><article>{ART}</article><style>p {{}}</style>",
    "script without end": f"<article>{ART}</article><script>document.write('<p>{LINE}</p>')",
    "comments below": f'<article>{ART}</article><section id="comments"><ol class="comment-list"><li><article class="comment-body"><p>{REMARK}</p></article></ol></section>',
    "comments inside": f'<article>{ART}<div class="comments-area"><p>{REMARK}</p></div></article>',
    "teasers beside": f'<div class="related"><article><h2>Other</h2><p>{LINE}</p></article></div><article>{ART}</article>',
    "advert of prose": f'<div class="ad"><p>{LINE}</p></div><article>{ART}</article><div class="newsletter signup"><p>{LINE}</p></div>',
    "advert in bare list items": f'<ul><li class="ad">{LINE}<li>a</ul><article>{ART}</article>',
    "no article at all": f'<div id="top">{MENU}</div><div class="content">{ART}</div><div class="footer"><p>{LINE}</p></div><ul><li><a href="/">Home</a></ul>',
    "stray ends": f"</div></p></article><article></span>{ART}</li></section></article></div>",
    "no ends": f"<body><nav>{MENU}</nav><article>{ART.replace('</p>', '')}",
    "capitals": f"<ARTICLE>{ART.replace('p>', 'P>')}</ARTICLE><FOOTER><P>{LINE}</P></FOOTER>",
    "header inside": f"<header>{MENU}</header><article><header>{HEAD}</header>{BODY}<footer><p>{LINE}</p></footer></article>",
    "declarations": f"<?xml version='1.0'?><!DOCTYPE html><!-- <p>{LINE}</p> --><![CDATA[<article>{ART}</article>]]>".replace("]]>", ""),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shape(name):
    assert html_text.main_text(SHAPES[name]) == TEXT


def test_pages_without_an_article_text():
    assert html_text.main_text(f'<nav>{MENU}</nav><div class="ad"><p>{LINE}</p></div><article></article>') == ""
    assert html_text.main_text(f'<div id="comments"><p>{REMARK}</p></div>') == ""
    # a short article isn't overruled by a longer advert
    assert html_text.main_text(f'<div class="ad"><p>{LINE * 5}</p></div><article><p>It is so.</p></article>') == "It is so."


HOSTILE = {
    "open quotes": '<a href="', "quotes of both kinds": "<a b=\"c' d='e\" ", "open tags": "<a ", "angles": "<", "ends": "</", "declarations": "<!", "comments": "<!--", "sections": "<![CDATA[",
    "scripts": "<script>", "frames": "<iframe>", "buttons": "<button>", "divs": "<div>", "marks": '<div class="ad">x', "equals": "<a =", "references": "&amp", "items": "<ul><li>", "heads": "<head>",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte_of_bad_markup_takes_seconds(name):
    for tail in ("", "</p></span></section></li>" * 10_000, "'\">"):
        page = HOSTILE[name] * (1_000_000 // len(HOSTILE[name])) + tail
        began = time.process_time()
        assert isinstance(html_text.main_text(page), str)
        assert time.process_time() - began < 6


PROSE = "<p>" + "The text of the article is long and it has many words. " * 6 + "</p>"
RUSSIAN = "<p>Это длинный абзац русского текста, который рассказывает о разных вещах. Он состоит из нескольких предложений, и каждое из них заканчивается точкой. Читатель легко поймет смысл.</p>"
CHINESE = "<p>" + "这是一个很长的中文段落，里面有许多句子。" * 10 + "</p>"


def test_any_language_is_read():
    menu = "<div class=nav><a href=x>Главная</a></div>"
    assert html_text.main_text(f"<body>{menu}<div>{RUSSIAN}{RUSSIAN}</div><div><a href=y>Ещё</a></div></body>").count("длинный абзац") == 2
    assert len(html_text.main_text(f"<body><div>{CHINESE}</div></body>")) == 200


def test_sections_of_an_article_stay_whatever_their_names():
    kept = "".join(f"<section {a}><p>Part {i} is kept.</p></section>" for i, a in enumerate(['id="related-work"', 'id="ad-hoc-methods"', 'class="social-history"', 'class="menu-of-the-day"']))
    gone = "".join(f"<div class='{c}'><p>Buy now.</p></div>" for c in ("ad-slot", "ad", "related-posts", "newsletter"))
    text = html_text.main_text(f"<article>{PROSE}{kept}{gone}{PROSE}</article>")
    assert all(f"Part {i} is kept." in text for i in range(4)) and "Buy" not in text


def test_what_is_not_shown_is_left_out():
    text = html_text.main_text(f"<article>{PROSE}<div hidden><p>Secret one.</p></div><div style='color: red; display:none'><p>Secret two.</p></div><div data-x='hidden'><p>It is shown.</p></div></article>")
    assert "Secret" not in text and "It is shown." in text


def test_menus_without_an_end_stop_at_the_article():
    for tag in ("nav", "aside"):
        text = html_text.main_text(f"<body><{tag}><a href=x>Home</a><ul><li>x</ul><article><h1>T</h1>{PROSE}</article></body>")
        assert text.startswith("T\n\nThe text of the article")
        assert html_text.main_text(f"<body><{tag}><h1>Menu</h1>{PROSE}</{tag}><p>x</p></body>") == ""


def test_sentences_beside_links_stay_in_an_article():
    text = html_text.main_text(f"<article>{PROSE}<p>See <a href=x>the other long page about it</a>.</p><p>The end.</p></article>")
    assert text.endswith("See the other long page about it.\n\nThe end.")
