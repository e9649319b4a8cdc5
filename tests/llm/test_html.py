import html as entities
import re

import pytest

from peerscreen.llm import html_text
from peerscreen.llm.html_text import main_text

SF = "/root/testdata/sf0.001"
BODY = "<p>A paragraph of some length, with commas, and words enough to count as text.</p><p>Another one, also long, with &eacute;, &amp; and &#233; in it.</p>"


def test_articles_of_the_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.extracted(pages.withColumn("text", pages.url)).collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(p for p in parts if p)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><a>x</a></nav><div id=main>{BODY}</div><aside><p>Side text, long enough, to be mistaken for text.</p></aside></body>",
        f"<div class='header'>Head, of the site, with words</div><section>{BODY}</section><div class='comments'><p>I disagree, strongly, with all of it, dear author.</p></div>",
        f"<article>{BODY}<form><p>Sign up, now, for our letter, it is free of charge</p></form></article><footer>Foot</footer>",
        f"<div><div class='cookie-notice'>We use cookies, many of them, on this site</div><div class='content has-sidebar'>{BODY}</div></div>",
        f"<script>var a = '<p>no</p>';</script><style>p {{}}</style><!-- <p>no</p> --><main>{BODY}<div class='ad'>Buy</div></main>",
        f"<div role='navigation'>menu</div><td>{BODY}</td><ul class='related'><li>more, and more, and more of the same here</li></ul>",
    ],
)
def test_boilerplate_goes(page):
    assert main_text(page) == "A paragraph of some length, with commas, and words enough to count as text.\nAnother one, also long, with é, & and é in it."


def test_parts_of_an_article_stay_together():
    page = f"<article><section>{BODY * 6}</section><section><p>Short end, of it.</p></section><div class='share'>Share</div></article>"
    assert main_text(page).count("\n") == 12 and main_text(page).endswith("Short end, of it.")
    page = f"<body><div id='top'><div class='part'>{BODY * 6}</div><div class='part'><p>Short end, of it.</p></div></div></body>"
    assert main_text(page).endswith("Short end, of it.")


def test_siblings_and_links():
    links = "".join(f"<li><a href=/{i}>A link, with words, number {i}</a></li>" for i in range(30))
    page = f"<div><div><ul>{links}</ul></div><div>{BODY}</div><h2>Heading</h2><div>{BODY}</div></div>"
    text = main_text(page)
    assert text.count("A paragraph") == 2 and "Heading" in text and "A link" not in text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<nav>menu</nav>", ""), ("plain < text & more", "plain < text & more"), ("<p>a<p>b<br>c", "a\nb c"),
        ("<p>x &lt;b&gt; &nope; &#x1F642;</p>", "x <b> &nope; 🙂"), ("<div>" * 3000 + "deep, text", "deep, text"), ("</div></p>left", "left"),
        ("<a href='unclosed>text", "text"), ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<!-- open", ""),
    ],
)
def test_edges(page, text):
    assert main_text(page) == text


def test_long_page_is_whole():
    page = "<article>" + "".join(f"<p>Paragraph {i}, of many, in one page.</p>" for i in range(20_000)) + "</article>"
    assert len(main_text(page).split("\n")) == 20_000


def test_empty_table(spark):
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
