"""Reader comments by many names stay out of the main text, wherever they stand; wrappers that only tell of comments, parts of articles and linked paragraphs stay in."""

from __future__ import annotations

import time

import pytest

from frameflow.llm import html_text

GOOD = "This is the text of the page and it is long enough to be the main part of it."
SAID = "I have read this and I do not think that it is right, as we all have seen it before with our own eyes."
NAMES = ["user-comments", "reader-comments", "article-comments", "post-comments", "fb-comments", "comment-body", "discussion", "responses", "author-bio", "advertorial", "comments", "comment-list", "commentList", "comments-area", "comment_thread", "disqus_thread"]
ARTICLE = f"<h1>Head</h1><p>{GOOD}</p><p>{GOOD}</p>"
TEXT = f"Head\n\n{GOOD}\n\n{GOOD}"


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_comments_go(name, attribute):
    said = f"<div {attribute}='{name}'><p>{SAID}</p><div><p>{SAID * 2}</p></div><p>{SAID}</p></div>"
    for page in (
        f"<article>{ARTICLE}{said}</article>", f"<article>{ARTICLE}</article>{said}", f"<div>{ARTICLE}{said}</div>", f"<div>{ARTICLE}</div>{said}", f"{ARTICLE}{said}",
        f"<main><div class=post>{ARTICLE}</div><section {attribute}={name}><h3>Comments (2)</h3><article><p>{SAID}</p></article><article><p>{SAID * 3}</p></article></section></main>",
        f"<article>{ARTICLE}{said * 20}</article><footer>{SAID}</footer>",
    ):
        assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize("name", ["comments-open", "no-comments", "has-comments", "post-with-comments", "comment-status-open", "comments", "user-comments"])
def test_wrappers_stay(name):
    """The page's own text in a wrapper with such a name, with comments inside it or not."""
    said = f"<div class='user-comments'><p>{SAID}</p></div>"
    for page in (f"<div class='{name}'><article>{ARTICLE}</article></div>", f"<article class='{name}'>{ARTICLE}{said}</article>", f"<div class='{name}'>{ARTICLE}{said}</div>", f"<body class='{name}'><div>{ARTICLE}</div>{said}</body>",
                 f"<h1>Head</h1><div class='{name}'><p>{GOOD}</p><p>{GOOD}</p></div>", f"<div class='{name}'><div class='{name}'>{ARTICLE}</div>{said}</div>"):
        assert html_text.main_text(page) == TEXT


def test_a_part_of_an_article_may_be_a_discussion():
    page = f"<article>{ARTICLE}<section id='discussion'><h2>Discussion</h2><p>{SAID}</p></section></article>"
    assert html_text.main_text(page) == f"{TEXT}\n\nDiscussion\n\n{SAID}"
    for heading in ("Discussion (12)", "Discussion: 3 comments"):
        assert html_text.main_text(page.replace("<h2>Discussion</h2>", f"<h2>{heading}</h2>")) == TEXT


def test_linked_paragraphs_of_an_article_stay():
    link = "A long paragraph of an article of which almost every word is a link to another page of the site"
    assert html_text.main_text(f"<article>{ARTICLE}<p><a href=x>{link}</a>.</p><p>{GOOD}</p></article>") == f"{TEXT}\n\n{link}.\n\n{GOOD}"
    assert html_text.main_text(f"<div>{ARTICLE}</div><div><a href=x>{link}</a></div>") == TEXT


def test_many_containers_in_linear_time():
    page = f"<article>{ARTICLE}</article>" + f"<div class='user-comments'><p>{SAID}</p></div>" * 20_000
    began = time.time()
    assert html_text.main_text(page) == TEXT
    assert time.time() - began < 20
    deep = f"<div>{ARTICLE}" + "<div class='reply'>" * 3_000 + f"<p>{SAID}</p>" * 50
    assert html_text.main_text(deep) == TEXT
