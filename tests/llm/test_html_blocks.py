"""The line-block distribution: windows against a plain version, pages without marked articles, hostile pages."""

import random
import time

import pytest

from docstrata.llm.html import extract_main_text, rows_of, surges

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def plain_page(seed):
    """Blocks of long and short lines without any telling tag or class, with some zones between them."""
    r, out = random.Random(seed), []
    for _ in range(r.randint(2, 8)):
        kind = r.random()
        if kind < 0.4:
            out += [f"<div>{prose(r, r.randint(20, 80))}</div>" for _ in range(r.randint(1, 4))]
        elif kind < 0.7:
            out += [f"<div>{r.choice(WORDS)}</div>" for _ in range(r.randint(1, 7))]
        elif kind < 0.85:
            out += ["<nav>" + "".join(f"<li><a href=x>{r.choice(WORDS)}</a>" for _ in range(r.randint(1, 5))) + "</nav>"]
        else:
            out += [f"<div><a href=y>{prose(r, 3)}</a></div>" for _ in range(r.randint(1, 4))]
    return "<body>" + "".join(out) + "</body>"


def brute(page, window, share):
    """Straight from the definition: a row stays if some window over it reaches the share of the largest window."""
    rows = rows_of(page)
    n = [0 if x.noise else max(0, len(x.text) - x.linked) for x in rows]
    sums = {i: sum(n[i : i + window]) for i in range(len(rows))}
    least = max(1, share * max(sums.values(), default=0))
    good = [any(sums[i] >= least for i in range(max(0, j - window + 1), j + 1)) for j in range(len(rows))]
    return "\n".join(x.text for x, g in zip(rows, good) if g and x.text and not x.noise)


@pytest.mark.parametrize("window,share", [(1, 0.01), (3, 0.01), (3, 0.1), (5, 0.3), (40, 0.01)])
def test_windows_against_the_definition(window, share):
    for seed in range(150):
        page = plain_page(seed)
        assert extract_main_text(page, window, share) == brute(page, window, share)


def test_windows_and_threshold_decide():
    pages = [plain_page(s) for s in range(60)]
    texts = {(w, s): [extract_main_text(p, w, s) for p in pages] for w, s in ((1, 0.01), (3, 0.01), (8, 0.01), (3, 0.2))}
    assert len({tuple(t) for t in texts.values()}) == 4


def test_page_without_marked_article():
    r = random.Random(1)
    body = [prose(r, 70) for _ in range(6)]
    menu = "".join(f"<div><a href=/{w}>{w}</a></div>" for w in WORDS)
    foot = "".join(f"<div><a href=/{w}>{w} more</a></div>" for w in WORDS) + "<div>All rights</div>"
    page = f"<html><body>{menu}<h1>Title here</h1>{''.join(f'<p>{p}</p>' for p in body[:3])}<p>Short.</p>{''.join(f'<div>{p}</div>' for p in body[3:])}{foot}</body></html>"
    kept = extract_main_text(page).split("\n")
    start = kept.index("Title here")
    assert kept[start : start + 8] == ["Title here", *body[:3], "Short.", *body[3:]]
    assert "All rights" not in kept and len(kept) <= 8 + 4  # linked lines in a window's reach may stay, the rest goes


def test_surge_and_dive_points():
    assert surges([0, 0, 0, 0, 5, 0, 0, 0, 0, 900, 0, 0, 0]) == [(7, 12)]  # 5 is less than a hundredth of 900
    assert surges([0, 0, 0, 0, 50, 0, 0, 0, 0, 900, 0, 0, 0]) == [(2, 7), (7, 12)]
    assert surges([]) == [] and surges([0, 0]) == []


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p>one<br>two<br/>\nthree</p></article>", "one two three"),
        ("<article><p>Long text here</p><div class=comments>" + "<p>Reply</p>" * 9 + "</div><p>Short.</p><p><a href=x>Linked.</a></p></article><p>no</p>", "Long text here\nShort.\nLinked."),
        ("<article><p><a href=x>all linked</a></p></article><footer>f</footer>", "all linked"),
        ("<p>a</p><div class=sidebar>s</div>tail <b>bold</b> end<div class='x", "a\ntail bold end"),
        ("<article><p title=it's>Don't</p><p>won't</p></article>", "Don't\nwon't"),
        ("<article><a title='a > b' href=\"x\">T</a>ext</article>", "Text"),
        ("<article><p>x</p><form><p>Name</p></form><p>y</p><section role=complementary>z</section></article>", "x\ny"),
        ("<article>a</b></i></nav></article></div><aside>q</aside>", "a"),
        ("<ARTICLE><P>Upper</P></ARTICLE><FOOTER>F</FOOTER>", "Upper"),
    ],
)
def test_pages(page, text):
    assert extract_main_text(page) == text


HOSTILE = {
    "nested": "<nav>" + "<div>" * 40_000 + "</p></span>" * 40_000 + "</div>" * 40_000 + "</nav><p>Text</p>",
    "quotes": '<a "' * 40_000 + "x",
    "values": '<a x=">"' * 40_000,
    "open": "<a href='" * 40_000 + ">",
    "angles": "<" * 200_000,
    "comments": "<!--" * 60_000,
    "ends": "<article>" * 20_000 + "</article></main>" * 20_000,
    "scripts": "<script>" * 50_000,
    "spaces": "<p class" + " " * 200_000 + "=x>y</p>",
    "references": "&amp;" * 50_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_take_time_by_their_length(name):
    begin = time.time()
    text = extract_main_text(HOSTILE[name])
    assert time.time() - begin < 3
    assert (name != "nested" or text == "Text") and (name != "angles" or len(text) == 200_000)


def test_pages_with_repeated_ids(spark):
    from docstrata.llm.html import extract_pages

    rows = [(1, "u", "<article>a</article>"), (1, "u", "<article>a</article>"), (1, "v", "<article>bc</article>"), (None, None, "<p>d")]
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(0, "d", 1), (1, "a", 1), (1, "a", 1), (1, "bc", 2)]
