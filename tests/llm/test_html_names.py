"""Attributes, names and forms: what must stay in the main text, and what must go."""

import pyarrow.parquet as pq
import pytest

from hopweave.llm import html


def text(body):
    return html.text_of(html.parsed(f"<html><body><nav>Menu</nav>{body}<footer>Foot</footer></body></html>"))


KEPT = [
    '<h1 class="post-header">Kept words</h1>', '<h2 id="search">Kept words</h2>', '<h2 id="comments">Kept words</h2>', '<h1 class="header">Kept words</h1>', '<p title="the hidden cave">Kept words</p>',
    '<p>Kept <a href="/hidden-valley">words</a></p>', '<p data-hidden="false">Kept words</p>', '<p data-id="share">Kept words</p>', '<p id="navigation">Kept words</p>', '<p>Kept <span class="text-social">words</span></p>', "<p><label>Kept</label> words</p>",
    '<div class="post-header"><h1>Kept words</h1></div>', '<p data-x="class=ad role=menu">Kept words</p>', '<p alt=\'id="nav" hidden\'>Kept words</p>', '<div class="share-of-voice">Kept words</div>', '<div class="menu-planning">Kept words</div>',
    '<p data-role="navigation">Kept words</p>', '<p x="style=display:none">Kept words</p>', '<div data-class="ad">Kept words</div>', '<a title="a>b" href=x hidden-x>Kept words</a>',
]


@pytest.mark.parametrize("piece", KEPT)
@pytest.mark.parametrize("around", ["<article>{}<p>More.</p></article>", "<main>{}<p>More.</p></main>", "<div>{}<p>More.</p></div>"])
def test_main_text_stays(piece, around):
    assert text(around.format(piece)) == "Kept words\nMore."


GONE = [
    '<div class="ad">x</div>', '<div class="ad-slot">x</div>', '<p class="ad">x</p>', '<aside>x</aside>', '<div class="newsletter-signup">x</div>', '<ul class="breadcrumbs"><li>x</li></ul>', '<div class="share-buttons">x</div>', '<section class="comment-list">x</section>',
    '<div id="comments">x</div>', '<div hidden>x</div>', "<div style='display: none'>x</div>", '<div role="navigation">x</div>', "<form><label>x</label><input><button>x</button></form>", '<div class="cookie-banner">x</div>', '<DIV CLASS=sidebar>x</DIV>',
]


@pytest.mark.parametrize("piece", GONE)
def test_boilerplate_goes(piece):
    assert text(f"<article><p>Kept words and more of them.</p>{piece}</article>") == "Kept words and more of them."
    assert text(f'<div class="site-header">Logo</div><div id="main-menu">y</div><p>Kept words and more of them.</p>{piece}') == "Kept words and more of them."


def test_a_form_around_the_page_is_no_form():
    assert text('<form action="/"><div><h1>Title</h1><p>All of the text is in here.</p></div><input><select><option>x</option></select></form>') == "Title\nAll of the text is in here."
    assert text("<form><article><p>One.</p></article><textarea>much more text than the article has in all</textarea></form>") == "One."


def test_pages_gain_no_menu_advert_or_footer():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        root = html.parsed(page or "")
        got = html.text_of(root).split("\n")
        for node in html._walk(root):
            if node.tag in ("nav", "footer") or "ad" in node.names:
                for c in [node, *html._walk(node)]:
                    assert not c.own() or c.own() not in got or page.count(c.own()[:30]) > 1  # some adverts quote the article
