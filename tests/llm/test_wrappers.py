"""Layout wrappers with furniture words in their names."""

import pytest

from codeloom.llm import html

from .conftest import prose

WRAP = {
    "sidebar": ('<div class="layout right-sidebar">', "</div>"), "header": ('<div id="page" class="no-header"><div class="with-comments">', "</div></div>"), "form": ('<form id="aspnet" method="post">', "</form>"),
    "plain": ("<div>", "</div>"),
}
EXTRA = '<nav>menu</nav><div class="sidebar">side side</div>'
COMMENTS = '<div class="comments"><article class="comment"><p>' + prose(7, 15) + "</p></article></div>"
BODY = {"article": "<article><h1>{h}</h1><p>{t}</p><p>{t}</p></article>", "heading": '<div class="c"><h1>{h}</h1><p>{t}</p><p>{t}</p></div>', "text": '<div class="c"><p>{h}</p><p>{t}</p><p>{t}</p></div>'}


@pytest.mark.parametrize("body", sorted(BODY))
@pytest.mark.parametrize("wrap", sorted(WRAP))
def test_article_in_a_wrapper(spark, wrap, body):
    first, last = WRAP[wrap]
    rows = [(i, "http://h.org/x", f"<html><body>{EXTRA}{first}{BODY[body].format(h=f'Title {i}', t=prose(i, 40))}{EXTRA}{COMMENTS}{last}<footer>end</footer></body></html>") for i in range(6)]
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\n{prose(i, 40)}\n{prose(i, 40)}" for i in range(6)}
    assert html.main_text(rows[0][2], "", frozenset()) == got[0]


def test_long_comments_are_still_furniture():
    page = "<body><div class='c'><h1>T</h1><p>" + prose(1, 60) + "</p></div><div class='comments'>" + "".join(f"<article><p>{prose(i, 40)}</p></article>" for i in range(9)) + "</div></body>"
    assert html.main_text(page, "", frozenset()) == "T\n" + prose(1, 60) and html.main_text("<body><nav>a</nav></body>", "", frozenset()) == ""
