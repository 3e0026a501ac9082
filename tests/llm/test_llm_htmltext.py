from __future__ import annotations

import html
import random
import re
import time
from collections import Counter

import pytest
from llm_tools import sentence

from sondera.llm import htmltext
from sondera.llm.htmltext import extract

ARTICLE = ["First paragraph, which is long enough to be told from a menu; it has marks.", "Second paragraph with <b>bold</b>, <a href='/x'>a link</a> and an &amp; sign &#x2014; &eacute;.", "Third one: short.", "A last paragraph, again of some length, so that it is content as well."]
PLAIN = "First paragraph, which is long enough to be told from a menu; it has marks. Second paragraph with bold, a link and an & sign — é. Third one: short. A last paragraph, again of some length, so that it is content as well."
MENU = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Menu {i}</a></li>" for i in range(8)) + "</ul></nav>"


def _body(wrap="article", attrs=""):
    return f"<{wrap}{attrs}>" + "".join(f"<p>{p}</p>\n" for p in ARTICLE) + f"</{wrap}>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p {{}}</style></head><body>{MENU}{_body()}<footer>Copyright 2024, all rights reserved.</footer></body></html>",
        f"<body><div id='header'><h1>Site</h1></div>{MENU}<div class='post-content'>{_body('div')}</div><div class='sidebar'><p>Popular posts, which are long as well, and have marks.</p></div></body>",
        f"<body>{MENU}<main>{_body('div')}<form><p>Subscribe to our newsletter, it is free, they say.</p><input></form></main><div class='cookie-banner'>We use cookies, as all do, to be nice.</div></body>",
        f"<body><script>var a = '<p>no</p>';</script>{_body('div')}<section id='comments'><p>A reader wrote a long comment, with many marks, here.</p></section><!-- <p>hidden</p> --></body>",
        f"<BODY>{MENU}{_body('DIV').replace('</p>', '')}<aside><p>An aside of some length, which is not the article.</p></aside></BODY>",
        f"<body><div class='ads'><p>Buy this now, it is very cheap, really.</p></div>{_body('section')}<noscript>Enable scripts, please.</noscript></body>",
    ],
)
def test_article_without_what_surrounds_it(page):
    assert htmltext.extract(page) == PLAIN


def test_white_space_references_and_order():
    assert htmltext.extract("<p>a&nbsp;b\n\t c&lt;d&gt; &unknown; &#65;</p><p> e </p>") == "a b c<d> &unknown; A e"
    assert htmltext.extract("<article><h1>Head</h1><p>one<br>two</p><ul><li>x, y</li><li>z.</li></ul></article>") == "Head one two x, y z."


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<!-- only", "<script>x", "<p></p>", "<nav>menu</nav>"])
def test_pages_without_text(page):
    assert htmltext.extract(page) == ""


@pytest.mark.parametrize("page", ["<", "<p", "<p>a</b></p>", "</div></div>a", "<a <b>x", "<p class='x>y</p>", "a < b > c", "<table><tr><td>1<tr><td>2", "<li>a<li>b<p>c<p>d", "<p/>x", "&", "&#xFFFFFFFF; z", "<div " + "a=b " * 2000 + ">t</div>"])
def test_broken_markup_gives_some_text(page):
    assert isinstance(htmltext.extract(page), str)


def test_a_very_long_page_is_whole():
    r = random.Random(4)
    paragraphs = [sentence(r, 40) + "." for _ in range(5000)]
    page = MENU + "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"
    assert htmltext.extract(page) == " ".join(paragraphs)


def test_deep_nesting_is_linear():
    page = "<div>" * 3000 + "<p>A text, deep inside.</p>" + "</div>" * 3000
    assert htmltext.extract(page) == "A text, deep inside."


def test_pages_table(spark):
    rows = [(1, "u", f"<article><p>{ARTICLE[0]}</p></article>", "k"), (1, "u", None, "k"), (None, None, "<p>x</p>", "k"), (2, "v", "", "k")]
    got = htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got), key=repr) == sorted([(1, "u", ARTICLE[0], len(ARTICLE[0])), (1, "u", "", 0), (None, None, "x", 1), (2, "v", "", 0)], key=repr)
    assert htmltext.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_scores_put_content_paths_first():
    found = htmltext.blocks("<div>" + "".join(f"<p>{sentence(random.Random(i), 30)}, and. So!</p>" for i in range(6)) + "</div><table>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(6)) + "</table>")
    s = htmltext.path_scores(found)
    assert s["/div/p"] > 3 * s["/table/tr/td"]


def test_scripts_end_with_their_end_tag():
    assert extract('<article><p>One two three.</p><script src="a.js"/>var leaked=1;</script><p>Four.</p></article>') == "One two three. Four."
    assert extract("<article><p>One.</p><SCRIPT>a</Script ><p>Two.</p><svg/><p>Three.</p></article>") == "One. Two. Three."
    assert extract("<article><p>One.</p><noscript><p>Two.</p></article>") == "One. Two."
    assert extract("<article><p>One.</p><script>var x = 1; <p>Two.</p></article>") == "One."


def test_open_quotes_and_tags():
    assert extract('<article><p class="x>One two.</p><p>Three.</p></article>') == "One two. Three."
    assert extract("<article><p title='a > b'>One.</p><p title=it's>Two.</p></article>") == "One. Two."
    assert extract('<article><p>One < two and 3 <4.</p><p class="a') == "One < two and 3 <4."
    assert extract("<article><p>One.<!-- no end <p>Two.</p>") == "One."
    assert extract("<article><p>One.</p><!--> <p>Two.</p></article>") == "One. Two."


@pytest.mark.parametrize("part", ['<p class="', "<p a='", '<a b="c', "<script>", "<svg>", "<!--", "<![CDATA[", "<", "</", "<p =", "<!", "<template>"])
def test_time_is_linear_on_broken_pages(part):
    page = part * (400_000 // len(part))
    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 20


def test_articles_of_all_pages(spark, sf):
    """Against the plain text of the article element, cut at block tags by regular expressions."""
    from sondera.llm import queries

    big = sf.replace("sf0.001", "sf0.01")
    want = {}
    for r in spark.read.parquet(f"{big}/pages.parquet").collect():
        body = re.search("<article>(.*?)</article>", r["html"] or "", re.S)
        parts = re.split("</?(?:article|p|h1|ul|ol|li|div|blockquote|h2|h3)[^>]*>", body[1]) if body else []
        texts = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts]
        want[r["page_id"]] = " ".join(t for t in texts if t)
    got = {r["page_id"]: r["text"] for r in queries.op10_html_extract(spark, big).collect()}
    words = lambda t: Counter(t.split())
    both = sum((words(got[i]) & words(want[i])).total() for i in want)
    assert both >= 0.99 * sum(len(t.split()) for t in want.values())
    assert both >= 0.99 * sum(len(t.split()) for t in got.values())
    assert sum(got[i] == t for i, t in want.items()) >= 0.95 * len(want)
