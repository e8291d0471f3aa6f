from __future__ import annotations

import html
import re

from tests.conftest import SF
from tessera.llm import html_density as H
from tessera.llm import queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head><body class="home sidebar-left">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<aside><p>Side words</p></aside>
<div id="content"><article><header><h1>Real &amp; title</h1></header><p>First   paragraph with <b>bold</b>, <a href="x">a link</a> and more text to read.<p>Second one &eacute;t&#233; &amp
goes on for a while, as texts do.<div class="ad">Buy now</div><ul><li>one thing<li>another thing</ul>
<blockquote>Quoted words stand here.</blockquote><form><input value="q">Search</form><pre>a
  b</pre></article>
<section id="comments"><p>Great post, I agree with every word of it!</p></section></div>
<footer>&copy; me</footer></body></html>"""


def test_article_only():
    assert H.main_text(PAGE).split("\n\n") == [
        "Real & title", "First paragraph with bold, a link and more text to read.", "Second one été & goes on for a while, as texts do.", "one thing", "another thing", "Quoted words stand here.", "a b",
    ]


def test_without_article_element():
    body = "".join(f"<p>Paragraph {i} has a number of words, and they make it long enough.</p>" for i in range(6))
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><div>{body}</div></div><div>Copyright <a href='/'>all</a></div></body>"
    assert H.main_text(page).split("\n\n") == [f"Paragraph {i} has a number of words, and they make it long enough." for i in range(6)]


def test_odd_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p>") == H.main_text("<!-- only -->") == ""
    assert H.main_text("plain words") == "plain words"
    assert H.main_text("<p>cut off <b>here <a href='") == "cut off here"
    assert H.main_text("a < b and c > d") == "a < b and c > d"
    assert H.main_text("</div></p><p>x") == "x"
    assert H.main_text("<p>one<br>two</p><p>one<br>two</p>") == "one two\n\none two"
    assert "deep" in H.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000)
    assert len(H.main_text("<p>" + "word " * 200_000 + "</p>")) == 999_999


def test_table_rows(spark):
    df = spark.createDataFrame([(1, None, None, 5), (None, "u", PAGE, 5), (None, "u", PAGE, 5)], "page_id long, url string, html string, text int")
    rows = H.extract(df).collect()
    assert [r.n_chars for r in rows] == [0, len(H.main_text(PAGE)), len(H.main_text(PAGE))]
    assert H.extract(df.limit(0)).collect() == []


def test_pages_of_the_table(spark):
    """The pages mark their article: its blocks, cut by hand."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op8_html(spark, SF).collect():
        inside = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id]).group(1)
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h\d)>", inside))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_text_after_scripts_and_styles():
    for code in ("for(i=0;i<n;i++){f()}", "if(a<b&&c>d){}", "<!-- a", "x=\"<a href='\"", "it's <b title=\"", "<p>'", "</scriptx>"):
        assert H.main_text(f"<script>{code}</script><article><p>Hello words</p></article>") == "Hello words"
        assert H.main_text(f"<p>Before</p><SCRIPT>{code}</Script ><p>Hello</p>") == "Before\n\nHello"
        assert H.main_text(f"<style>{code}</style\n><p>Hi</p>") == "Hi"
    assert H.main_text("<style><!-- a{} </style><p>Hi</p>") == "Hi"
    assert H.main_text("<p>Seen</p><script>if (a<b) never closed <p>no") == "Seen"
    assert H.main_text("<textarea><!-- </textarea><title>'<a</title><p>Hi</p>") == "Hi"


def test_deep_pages_are_decided_by_density():
    """Levels that add nothing to a page change nothing in its text."""
    for level in ("div", "span", "font"):
        deep = PAGE.replace("<article>", "<article>" + f"<{level}>" * 5000).replace("</article>", f"</{level}>" * 5000 + "</article>")
        assert H.main_text(deep) == H.main_text(PAGE)
    text = "A number of words that stand in the page, long enough to count."
    beside = "<aside>Side words</aside><div class='sidebar'>More of them</div><nav>One<nav>Two</nav>Three</nav>"
    assert H.main_text(beside + "<div>" * 5000 + f"<p>{text}</p>") == text


def test_marks_do_not_drop_the_article():
    text = "A number of words that stand in the page, and they are long enough to count."
    for mark in ("layout has-sidebar", "content no-sidebar", "post has-comments", "page ad-free", "menu-open", "sidebar", "search", "banner ads"):
        for inside in (f"<article><p>{text}</p></article>", f"<p>{text}</p><p>{text}</p>"):
            whole = "\n\n".join([text] * inside.count("<p>"))
            assert H.main_text(f"<body><div class='{mark}'>{inside}</div></body>") == whole
            assert H.main_text(f"<body><div id={mark.split()[0]}><div class='{mark}'>{inside}</div></div><footer>me</footer></body>") == whole
    assert H.main_text(f"<form id=f><nav>One</nav><main><p>{text}</p></main></form>") == text
    assert H.main_text(f"<article><p>{text}</p><div class=ad>Buy</div></article><section id=comments><article>{text * 9}</article></section>") == text
    assert H.main_text(f"<article><p>{text}</p><div class='cookie-notice'>x</div><div class='share-buttons'>x</div></article>") == text
    kept = f"<article><p>{text}</p><figure><figcaption>Caption</figcaption></figure><math><mi>x</mi></math></article>"
    assert H.main_text(kept) == f"{text}\n\nCaption\n\nx"
    for name in ("noscript", "object", "svg", "dialog"):
        assert H.main_text(f"<article><p>{text}</p><{name}>words</{name}></article>") == f"{text}\n\nwords"


LONG = "Many words stand in this paragraph of the text, and they go on for a while so that it is dense. " * 3
UNMARKED = (
    "<body><div><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Shop</a></li><li><a href=4>Help</a></li></ul></div>"
    "<div><p>Buy now.</p><p>Only today.</p></div>"
    f"<div><h1>Title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div>"
    "<div><p>Imprint</p><p>All rights reserved.</p></div></body>"
)


def test_density_alone_decides_pages_without_hints(monkeypatch):
    want = "\n\n".join(["Title", LONG.strip(), "Short one.", LONG.strip()])
    assert H.main_text(UNMARKED) == want
    assert H.main_text(UNMARKED.replace("<body>", "<body><div>").replace("</body>", "</div></body>")) == want
    values = iter([0.5, 0.9, 0.1, 0.7, 0.3] * 1000)
    monkeypatch.setattr(H, "_density", lambda node, share: next(values))
    assert H.main_text(UNMARKED) != want


def test_random_densities_change_the_table(spark, monkeypatch):
    import random

    pages = [r.html for r in spark.read.parquet(SF.replace("0.001", "0.01") + "/pages.parquet").collect()]
    right = [H.main_text(p) for p in pages]
    rng = random.Random(3)
    monkeypatch.setattr(H, "_density", lambda node, share: rng.random())
    assert sum(a != H.main_text(p) for a, p in zip(right, pages)) > 0


def test_menu_in_the_text_goes_by_its_links():
    menu = "<ul><li><a href=1>One thing</a></li><li><a href=2>Other thing</a></li><li><a href=3>Third thing</a></li></ul>"
    for tag in ("main", "article", "div"):
        assert H.main_text(f"<body><{tag}>{menu}<p>{LONG}</p><p>{LONG}</p></{tag}></body>") == f"{LONG.strip()}\n\n{LONG.strip()}"
    listed = "<ul><li>One thing</li><li>Other <a href=2>thing</a></li></ul>"
    assert "Other thing" in H.main_text(f"<body><main>{listed}<p>{LONG}</p></main></body>")


def test_words_of_a_class_take_nothing_out_of_an_article():
    for fragment, text in (
        ("<h2 id='search'>Search</h2>", "Search"), ("<p class='notice'>Notice this.</p>", "Notice this."), ("<section id='related-work'><p>Related work.</p></section>", "Related work."),
        ("<div class='side-effects'><p>Side effects.</p></div>", "Side effects."), ("<figure><figcaption>A caption.</figcaption></figure>", "A caption."), ("<math><mi>x</mi></math>", "x"),
        ("<section><h2>Last</h2><p>A line.</p></section>", "Last\n\nA line."), ("<p><a href=1>A linked line</a></p>", "A linked line"),
    ):
        for before, after in ((f"<p>{LONG}</p>", ""), ("", f"<p>{LONG}</p>")):
            got = H.main_text(f"<body><nav><a href=1>x</a></nav><article>{before}{fragment}{after}</article><footer>me</footer></body>")
            assert got == "\n\n".join(x for x in (LONG.strip() if before else "", text, LONG.strip() if after else "") if x)


def test_sections_and_wrappers_stay_together():
    parts = f"<section><h2>One</h2><p>{LONG}</p><p>{LONG}</p></section><section><h2>Two</h2><p>{LONG}</p></section><section><p>The end.</p></section>"
    want = ["One", LONG.strip(), LONG.strip(), "Two", LONG.strip(), "The end."]
    assert H.main_text(f"<body><article><h1>T</h1>{parts}</article><div class=ad>Buy</div></body>") == "\n\n".join(["T", *want])
    assert H.main_text(f"<body><div><div>{parts}</div></div><div>Other words</div></body>") == "\n\n".join(want[:-1])
    assert H.main_text(f"<body><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div><div>me</div></body>") == "\n\n".join(["Title", LONG.strip(), LONG.strip()])


def test_readers_do_not_win_by_length():
    replies = "".join(f"<article><p>{LONG}</p><p>{LONG}</p></article>" for _ in range(8))
    assert H.main_text(f"<body><article><p>{LONG}</p><p>Short.</p></article><section id=comments>{replies}</section></body>") == f"{LONG.strip()}\n\nShort."


def test_deep_pages_without_hints():
    deep = "<div>" * 5000 + f"<p>{LONG}</p><p>{LONG}</p>" + "</div>" * 5000
    assert H.main_text(f"<body><div><p>Aside words</p></div>{deep}<div>me</div></body>") == f"{LONG.strip()}\n\n{LONG.strip()}"


def test_hidden_is_the_name_of_an_attribute():
    page = '<body><article><p title="a hidden gem">One paragraph with words enough.</p><p data-note=\'not hidden here\'>Second with words enough.</p><p>See <a href="/" title="the hidden cost">the cost</a> of it all.</p><p hidden>Gone.</p><p class="x" hidden="">Gone too.</p></article></body>'
    assert H.main_text(page).split("\n\n") == ["One paragraph with words enough.", "Second with words enough.", "See the cost of it all."]


def test_comments_end_as_browsers_end_them():
    page = "<body><article><p>Before it all stands this.</p><!-- note --!><p>After it comes that one.</p><!-- a --><p>And more of it.</p></article></body>"
    assert H.main_text(page).split("\n\n") == ["Before it all stands this.", "After it comes that one.", "And more of it."]
