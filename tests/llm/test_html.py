import pytest

from docstrata.llm.html import extract_main_text, extract_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="ad-free">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use <b>cookies</b>.</div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>\n text.<br><p>Short.</p><div class="ad">Buy!</div><p>After the advert, &eacute;t&eacute;.</p>
<section id="comments"><p>Nice post</p></section></article><aside><p>Other news, a long sentence that goes on and on.</p></aside>
<form><label>Name</label></form><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    "page,text",
    [
        (PAGE, "Title & more\nFirst bold text.\nShort.\nAfter the advert, été."),
        (None, ""),
        ("", ""),
        ("<nav>only a menu</nav>", ""),
        ("plain words", "plain words"),
        ("<body><nav><a>x</a></nav><div><p>One long paragraph of text here.</p><p>Two.</p></div><div class='sidebar'>side</div></body>", "One long paragraph of text here.\nTwo."),
        ("<nav>never closed <ul><li>a<article><p>Body text</p></article><footer>f", "Body text"),
        ("<article><p>a < b and c</p><!-- <p>x</p> --><p>d &#233; &nosuch;</article>", "a < b and c\nd é &nosuch;"),
        ("<article><script>if (a) { '</article>' }</script><p>İx</p><SCRIPT>z</SCRIPT><p>end", "İx\nend"),
        ("<article><p>main main main main</p></article><article class='comment'><p>reply reply reply reply reply</p></article>", "main main main main"),
        ("<article><p class=notice>Note<p>Kept text</p></article>", "Kept text"),
        ("<article><header class='entry-header'><h1>Title</h1></header><p>Body text</p></article><div class='header'>Site</div>", "Title\nBody text"),
        ("<div class='site has-sidebar no-menu'><main class='content sidebar-left'><p>Body text</p><div class=sidebar>x</div></main></div>", "Body text"),
    ],
)
def test_pages(page, text):
    assert extract_main_text(page) == text


def test_long_page_and_table(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} with words.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", long), (2, None, None), (2, None, None), (3, "v", "<" * 50_000), (4, "w", "<a '" * 5_000)]
    got = sorted(extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")).collect())
    assert [r.page_id for r in got] == [1, 2, 2, 3, 4] and got[0].text.count("\n") == 19_999 and got[0].n_chars == len(got[0].text)
    assert got[1].text == "" and extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>Skip to content</p><article><p>p1</p><div class=ad>x</div><p>p2</p></article>", "p1\np2"),
        ("<p>Skip to content</p><main><p>Body text</p></main><p>after</p>", "Body text"),
        ("<article><p>first one</p></article><article><p>second, longer</p></article>", "second, longer"),
        ("<div><p>" + "long " * 50 + "</p><div class=ad>x</div><p>End.</p></div>", ("long " * 50).strip() + "\nEnd."),
        ("<div><p>Text</p><div class=ad></div><p><a href=x>linked end</a></p></div>", "Text\nlinked end"),
        ("<p>Text</p><nav>x</nav><ul><li><a href=x>only links</a></ul>", "Text"),
    ],
)
def test_blocks_end_with_their_article_and_are_not_lost_to_zones(page, text):
    assert extract_main_text(page) == text
