"""Zones and articles are judged by the text that they hold: cards next to bodies, wrappers with telling classes, zones without an end."""

import random
import time

import pytest

from docstrata.llm.html import extract_main_text

BODY = ["The council met on Monday to talk about the bridge, " * 14, "Nothing was decided before the evening session began, " * 13]
PARAGRAPHS = "".join(f"<p>{b}</p>" for b in BODY)
TEXT = "\n".join(b.strip() for b in BODY)


@pytest.mark.parametrize("classes", ["site menu-closed", "layout has-sidebar sidebar-left", "content search-results", "page footer-dark", "js no-ads login-off", "sidebar", "search"])
def test_a_wrapper_is_no_zone(classes):
    assert extract_main_text(f"<body><nav><a href=x>Home</a></nav><div class='{classes}'>{PARAGRAPHS}<div class=ad>Buy!</div></div><footer>Imprint</footer></body>") == TEXT


@pytest.mark.parametrize("name", ["share-price", "related-work", "ad-hoc", "menu-recipe", "reply-letter", "notice-of-decision", "search-methods", "alert-level"])
def test_a_paragraph_is_known_by_its_head_word(name):
    assert extract_main_text(f"<article>{PARAGRAPHS}<p class='{name}'>One more.</p></article>") == f"{TEXT}\nOne more."


@pytest.mark.parametrize("name", ["related-posts", "share-buttons", "ad-slot", "sidebar-left", "comment-list", "cookie-notice", "newsletter-form", "site-footer", "social-links"])
def test_zones_by_their_head_word(name):
    assert extract_main_text(f"<article>{PARAGRAPHS}<div class='{name}'><p>Not this.</p></div><p>Last.</p></article>") == f"{TEXT}\nLast."


CARD = "<article>See also: a card</article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{PARAGRAPHS}<div class=cards>{CARD}</div></body>",
        f"<body>{PARAGRAPHS}<div class=cards>{CARD * 6}</div></body>",
        f"<body><aside>{CARD}</aside>{PARAGRAPHS}</body>",
        f"<body><aside><div><article><p>Teaser</p></article></div></aside>{PARAGRAPHS}</body>",
        f"<body><aside>{CARD}</aside><article>{PARAGRAPHS}</article></body>",
        f"<body><div class=related>{CARD}</div><main>{PARAGRAPHS}</main>{CARD}</body>",
        f"<form action=x><input><header>Site</header>{PARAGRAPHS}<footer>f</footer></form>",
        f"<nav>never closed<ul><li>a<article>{PARAGRAPHS}</article>",
    ],
)
def test_a_card_is_no_article_and_a_frame_is_no_zone(page):
    assert extract_main_text(page) == TEXT


def test_comments_stay_out_however_long():
    assert extract_main_text(f"<article><p>{BODY[0]}</p><section id=comments>{PARAGRAPHS * 3}</section></article>") == BODY[0].strip()
    assert extract_main_text(f"<div><p>{BODY[0]}</p><div class='comment-list'>{PARAGRAPHS * 3}</div></div>") == BODY[0].strip()


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def made_page(seed):
    """A page and its main text: in an article or bare, in a wrapper of any class, with cards, menus, adverts, comments and forms around and in it."""
    r = random.Random(seed)
    prose = lambda a, b: " ".join(r.choice(WORDS) for _ in range(r.randint(a, b))) + "."
    body = [prose(30, 80) for _ in range(r.randint(3, 7))]
    noise = [
        lambda: f"<div class='{r.choice(['ad', 'ad-slot', 'banner', 'share-buttons', 'related', 'newsletter-form'])}'><p>{prose(2, 9)}</p></div>",
        lambda: f"<aside><article><h3>{prose(2, 4)}</h3><p>{prose(5, 9)}</p></article></aside>",
        lambda: f"<form><label>{prose(1, 3)}</label><button>go</button></form>",
        lambda: "<script>var a = '<p>';</script>",
    ]
    parts = []
    for b in body:
        parts.append(f"<{(tag := r.choice(['p', 'div', 'p class=ad-hoc', 'p id=search-methods']))}>{b}</{tag.split()[0]}>")
        if r.random() < 0.4:
            parts.append(r.choice(noise)())
    inner = "".join(parts)
    if marked := r.random() < 0.5:
        inner = f"<{(tag := r.choice(['article', 'main']))}>{inner}</{tag}>"
    cards = "".join(f"<article><p>{prose(2, 5)}</p></article>" for _ in range(r.randint(0, 3)))
    comments = f"<div id=comments>{''.join(f'<p>{prose(10, 60)}</p>' for _ in range(r.randint(0, 6)))}</div>"
    after = "".join(r.sample([cards, comments, r.choice(noise)(), f"<footer>{prose(3, 9)}</footer>"], 4))
    wrapper = r.choice(["site", "menu-closed", "layout has-sidebar sidebar-left", "search", "page footer-dark"])
    page = f"<html><body><nav><ul>{''.join(f'<li><a href=/{w}>{w}</a>' for w in WORDS)}</ul></nav><div class='{wrapper}'>{inner}{after}</div></body></html>"
    return page, "\n".join(body), marked


@pytest.mark.parametrize("block", range(4))
def test_made_pages(block):
    kinds = set()
    for seed in range(block * 100, block * 100 + 100):
        page, text, marked = made_page(seed)
        kinds.add(marked)
        assert extract_main_text(page) == text, seed
    assert kinds == {True, False}


@pytest.mark.parametrize(
    "page",
    ["<div class=ad>" * 30_000 + "<article>" + "<p>x</p>" * 30_000, ("<div class=ad><article>" * 20_000) + "x", "<div class=ad><p>y</p>" * 30_000 + "<main>z", "<aside><article>a</article>" * 20_000, "<article><div class=ad>" * 20_000 + "</div></article>" * 20_000],
)
def test_many_zones_take_time_by_their_number(page):
    begin = time.time()
    extract_main_text(page)
    assert time.time() - begin < 5
