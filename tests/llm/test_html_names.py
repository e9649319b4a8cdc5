import pytest

from peerscreen.llm import html_text
from peerscreen.llm.html_text import main_text

BODY = "".join(f"<p>A paragraph of some length, with commas, and words enough to count as text, number {i}.</p>" for i in range(6))
TALK = "".join(f"<div><p>I disagree, strongly, with all of it, dear author, as user {i} said before.</p></div>" for i in range(40))


@pytest.mark.parametrize("name", ["content sidebar-right", "layout side-left", "l-main header-fixed", "page nav-open", "wrap with sidebar", "sidebar-right"])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_wrappers_keep_the_article(name, tag):
    for inner in (BODY, f"<article><h1>Title</h1>{BODY}</article>", f"<div><nav>menu</nav><div>{BODY}</div></div>"):
        text = main_text(f"<body><div><p>By a person</p></div><{tag} class='{name}'>{inner}</{tag}></body>")
        assert text.count("A paragraph") == 6 and "menu" not in text


@pytest.mark.parametrize("name", ["discussion", "related-work", "responses", "search", "legal"])
def test_parts_of_a_paper_stay(name):
    part = f"<section id='{name}'><h2 id='{name}-1'>Title of it</h2><p>What the part says, in one sentence, of some length.</p></section>"
    for page in (f"<article>{BODY}{part}{BODY}</article>", f"<main>{BODY}{part.replace('section', 'div')}{BODY}</main>", f"<div>{BODY}{part}</div>"):
        text = main_text(page)
        assert "What the part says" in text and "Title of it" in text and text.count("A paragraph") == page.count("<p>A")
    assert main_text(f"<article><h2 id='{name}'>Title of it</h2>{BODY}</article>").startswith("Title of it")


def test_columns_of_such_names_stay_together():
    page = "".join(f"<div class='side-{i}'>{BODY}</div>" for i in range(5))
    assert main_text(f"<body>{page}</body>").count("A paragraph") == 30


@pytest.mark.parametrize("name", ["class='comments'", "id='comments'", "id='disqus' class='content'", "class='comment-list header-fixed'"])
def test_comments_go_even_if_they_are_longer(name):
    for page in (f"<div>{BODY}</div><div {name}>{TALK}</div>", f"<div class='content sidebar-right'>{BODY}<div {name}>{TALK}</div></div>", f"<article>{BODY}<div {name}>{TALK}</div></article>"):
        text = main_text(page)
        assert text.count("A paragraph") == 6 and "disagree" not in text


def test_names_alone():
    assert main_text("<div class='menu'>menu</div><div id='search'><h2>Search</h2></div>") == ""
    assert main_text(f"<div class='comments'>{BODY}</div>").count("A paragraph") == 6
    links = "".join(f"<li><a href=/{i}>A link, with words, number {i}</a></li>" for i in range(9))
    assert "A link" not in main_text(f"<article>{BODY}<div id='related'><h3>Related</h3><ul>{links}</ul></div></article>")


def test_tree_building_takes_linear_time():
    import time

    n = 60_000
    pages = ["<div>" * n + "<li>a<dd>" * n, "<p><table>" + "<i>" * n + "<div></div>" * n, "<ul>" * n + "<li>x" * n, "<p><b>" * n]
    for page in pages:  # about a megabyte and less
        began = time.time()
        html_text.tree(page)
        assert time.time() - began < 10
