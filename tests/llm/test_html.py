import time

import pytest

from twinline.llm.html_text import blocks, extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-banner">We use cookies</div>
<div class="wrap"><article class="post post-%d"><h1>Head&amp;line</h1><p>First <b>bold</b>&nbsp;text<br>goes   on.<p>Second &lt;tag&gt; &#233;.</p>
<div class="ad-slot">Buy!</div><ul><li>one<li>two</ul><form><p>mail</p></form><div id="comments"><p>Reader says</p></div></article>
<aside>Also read</aside></div><!-- x <p>hidden</p> --><footer>&copy; me</footer></body></html>"""
TEXT = "Head&line\n\nFirst bold text goes on.\n\nSecond <tag> é.\n\none\n\ntwo"


def test_article_only():
    text, path = main_text(blocks(PAGE % 7), None)
    assert text == TEXT
    assert path.endswith("article.post.post-#")


def test_broken_markup_does_not_crash():
    for page in ["", "<", "<p", "a<b", "</p></div>", "<script>x", "<!-- x", "<div><p>a</div>b", "<p class='x>y", "&#xFFFFFFF;", "<table><tr><td>a<td>b</table>"]:
        main_text(blocks(page), None)


@pytest.mark.parametrize(
    "part", ["<p ", "<", "</", "<!", "<!--", "<a href=\"", "<p class='", "<p x=<", "<div>", "<div>x", "<script>", "</script ", "&amp", "<b>a</b", "<li>y", "<p a = "]
)
def test_time_is_linear_in_broken_markup(part):
    page = "<p>begin</p>" + part * (2_000_000 // len(part)) + "end"
    start = time.process_time()
    found = blocks(page)
    assert time.process_time() - start < 10
    assert found[0].text.startswith("begin")


def test_tags_with_odd_signs():
    page = "<p data-x='a > b' title=\"c < d\">one</p><p a=1<2>two</p><p>3 < 4 and 5 > 4</p><!-- open"
    assert [b.text for b in blocks(page)] == ["one", "two", "3 < 4 and 5 > 4"]


def test_deep_nesting_keeps_the_text():
    deep = "<div>" * 5000 + "<p>inmost</p>" + "</div>" * 5000 + "<p>after</p>"
    assert [b.text for b in blocks(deep)] == ["inmost", "after"]
    assert len(blocks(deep)[0].containers) <= 64


def test_host_votes(spark):
    small = "<body><article class=post><p>tiny</p></article><div class=extra><p>" + "long other text " * 20 + "</p></div></body>"
    big = "<body><article class=post><p>" + "the article text " * 30 + "</p></article><div class=extra><p>x</p></div></body>"
    rows = [(i, f"https://h.example/{i}", big) for i in range(9)] + [(9, "https://h.example/9", small), (10, "http://alone/", small)]
    rows += [(11, None, None), (12, "no url", ""), (None, "https://h.example/x", big), (13, "https://h.example/z", "just text")]
    pages = spark.createDataFrame([(k, u, h, "t") for k, u, h in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert len(got) == len(rows)
    assert got[9].text == "tiny" and got[10].text.startswith("long other text")
    assert got[11].text == "" and got[11].n_chars == 0 and got[13].text == "just text"
    assert got[0].n_chars == len(got[0].text)
    assert extract(pages.limit(0)).count() == 0


def test_wrappers_with_noise_words_keep_their_text():
    words = "the article text " * 20
    for page in [
        f"<html class='menu-closed'><body><div class=text><p>{words}</p></div></body></html>",
        f"<html><body class='has-sidebar'><div class=text><p>{words}</p></div></body></html>",
        f"<body><main class='content with-sidebar'><p>{words}</p><div class=sidebar>Also</div></main></body>",
        f"<body><article class='post sponsored'><p>{words}</p><form><p>mail</p></form></article></body>",
        f"<body><form id='aspnetForm'><nav>Home</nav><div class=text><p>{words}</p></div><div class=promo>Buy</div></form></body>",
        f"<body><div class='page header-fixed'><div class=text><p>{words}</p></div></div><div id=comments><p>{words * 9}</p></div></body>",
    ]:
        assert main_text(blocks(page), None)[0] == words.strip(), page


def test_headline_beside_the_winning_container():
    body = "the article text " * 20
    page = f"<body><div class=content><h1>Headline</h1><div class=body><p>{body}</p></div><div><a href=x>More of this</a></div></div><div>Other</div></body>"
    assert main_text(blocks(page), None) == (f"Headline\n\n{body.strip()}", "body/div.content")
    assert main_text(blocks(page), "body/div.content/div.body")[0].startswith("Headline")
