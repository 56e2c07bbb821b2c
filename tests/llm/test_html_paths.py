import html
import re

from corpusflow.llm.html_paths import extract_main_text, main_text
from llm_helpers import FOLDER, needs_tables


@needs_tables
def test_equals_the_article(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r for r in extract_main_text(pages).collect()}
    for p in pages.collect():
        body = re.sub(r"<br>|</?(?:p|h1)>", " ", re.search(r"<article>(.*?)</article>", p.html, re.DOTALL)[1])
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", body)).split())
        assert got[p.page_id].text == want
        assert got[p.page_id].n_chars == len(want)


def test_leaves_out_what_is_no_article():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="sidebar-left"><header><p>Site, name.</p></header>
    <div id="cookie-notice"><p>We use cookies, is that fine, or not?</p></div><div class="sidebar"><p>Other, news.</p></div>
    <article><h1>A &lt;title&gt;</h1><p>One <b>bo</b>ld,\n  two.<p>Three&nbsp;four<br>five<script>var x = "</p>";</script>
    <form>Mail <input> <button>Go</button></form><div class="comments"><p>Nice, post!</p></div></article>
    <div class="ad">Buy this, buy that. And more, and more, of all the things.</div><footer>&copy; x</footer></body></html>"""
    assert main_text(page) == "A <title> One bold, two. Three four five"


def test_pages_without_article_tags():
    story = "<h2>Head</h2><p>Some long text, with marks. And more, yes.</p><p>Short.</p><ul><li>Point one, really.</li></ul>"
    page = f"<div><div class='menu'><a>a</a> <a>b</a></div><div class=story>{story}</div><div class='footer'>(c) x, y.</div></div>"
    assert main_text(page) == "Head Some long text, with marks. And more, yes. Short. Point one, really."
    assert main_text("plain text, no tags.") == "plain text, no tags."
    assert main_text("<p>a<b>b</i></p></div></b> <unclosed attr='<p>' x") == "ab"


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>Text, here."), (4, "u", "<" * 5000), (5, "u", "<div>" * 3000 + "deep, text"), (5, "u", "<!-- <p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = sorted((str(r.page_id), r.text) for r in extract_main_text(pages).collect())
    assert got == [("1", ""), ("2", ""), ("4", "<" * 5000), ("5", ""), ("5", "deep, text"), ("None", "Text, here.")]
    assert extract_main_text(pages.limit(0)).count() == 0


STORY = "".join(f"<p>Paragraph {k} tells, at length, of what came to pass; of who was there, and of why it went on so.</p>" for k in range(9))


def told(page):
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", page)).split())


def test_teasers_in_article_tags_are_no_story():
    teasers = "".join(f"<article class=card><h3>Teaser {k}</h3><p>Read about it, now.</p></article>" for k in range(6))
    page = f"<body><div class=text><h1>Head</h1>{STORY}</div><div class=more>{teasers}</div></body>"
    assert main_text(page) == told(f"<h1>Head</h1>{STORY}")


def test_link_lists_inside_main_go_and_plain_lists_stay():
    links = "<div class=others><ul>" + "".join(f"<li><a href=x>Other page {k}</a></li>" for k in range(12)) + "</ul></div>"
    steps = "<ul>" + "".join(f"<li>{k} eggs</li>" for k in range(5)) + "</ul>"
    page = f"<body><main><h1>Head</h1>{links}{STORY}{steps}</main><div>Elsewhere, this and that.</div></body>"
    assert main_text(page) == told(f"<h1>Head</h1>{STORY}{steps}")


def test_wrappers_with_listed_words_keep_their_text():
    for wrapper in ('<div class="has-sidebar">', '<div id="page-header-fixed">', "<form action=x>"):
        close = "</form>" if "form" in wrapper else "</div>"
        for story in (f"<article>{STORY}</article>", f"<div class=story>{STORY}</div>"):
            page = f"<body>{wrapper}<div class=sidebar><p>Other, news.</p></div>{story}{close}</body>"
            assert main_text(page) == told(STORY)
    nested = f'<form><div class="no-sidebar"><div class="search-enabled">{STORY}</div></div></form>'
    assert main_text(nested) == told(STORY)
    comments = f"<div class=comments>{STORY}{STORY}</div>"
    assert main_text(f"<article>{STORY}{comments}</article>") == told(STORY)
    assert main_text(f"<div class=story>{STORY}</div>{comments}") == told(STORY)


def test_longer_names_with_listed_words_are_judged_by_their_text():
    for name in ('class="social-history"', 'id="search-strategy"', "class=alert_story"):
        section = f"<section {name}><h2>Part</h2>{STORY}</section>"
        assert main_text(f"<body><article><h1>Head</h1>{STORY}{section}</article></body>") == told(f"<h1>Head</h1>{STORY}{section}")
    links = "".join(f"<a href=x>Share it on network {k}, please, do, now.</a> " for k in range(20))
    out = [
        f'<div class="social-links">{links}</div>',
        '<div class="related-posts"><h3>More</h3><p>Read on.</p></div>',
        f'<div class="comment-list">{STORY}</div>',
        f"<div class=social>{STORY}</div>",
        '<div class="share-bar">' + "<span>Like</span><i>x</i>" * 60 + "</div>",
    ]
    for part in out:
        assert main_text(f"<body><article><h1>Head</h1>{STORY}{part}</article></body>") == told(f"<h1>Head</h1>{STORY}")
