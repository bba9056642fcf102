"""Hosts whose template alone tells the main text: no article elements, no telling names."""

import random

import pytest

from codeloom.llm import html

from .conftest import prose

S = "page_id long, url string, html string"
PROMO = [prose(9000 + k, 18) for k in range(3)]


def host(n: int, name: str = "h.org"):
    """(row, expected text) of n pages: constant menus and notices, one of three adverts, headings and paragraphs of the page's own."""
    out = []
    for i in range(n):
        p = [prose(100 * i + k, 25) for k in range(2 + i % 4)]
        body = f'<div class="a1"><ul><li><a href="/">Start</a></li><li><a href="/b">Board</a></li></ul></div><div class="a2"><h1>Head {i}</h1><div class="q3">{PROMO[i % 3]}</div>'
        body += f"<p>{p[0]}</p><p>All pages of this place carry this very line of text</p>" + "".join(f"<p>{x}</p>" for x in p[1:]) + '</div><div class="a4">Made here since 1990</div>'
        out.append(((i, f"http://{name}/{i}", f"<html><head><title>t{i}</title></head><body>{body}</body></html>"), "\n".join([f"Head {i}", *p])))
    return out


@pytest.mark.parametrize("hosts", [100_000, 0])
def test_template_decides(spark, hosts):
    made = host(40)
    pages = spark.createDataFrame([m[0] for m in made], S).repartition(5)
    got = {r.page_id: r.text for r in html.extract_main_text(pages, html.TemplateRules(broadcast_hosts=hosts)).collect()}
    assert got == {m[0][0]: m[1] for m in made}
    # A page by itself has no template: everything that no name gives away stays.
    alone = html.main_text(made[0][0][2], "", frozenset())
    assert "Board" in alone and PROMO[0] in alone and alone != made[0][1]


def test_few_pages_have_no_template_text(spark):
    made = host(3)
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame([m[0] for m in made], S)).collect()}
    assert all("carry this very line" in t for t in got.values())


def test_copies_of_one_page_keep_their_text(spark):
    text = "\n".join(prose(k, 30) for k in range(4))
    page = "<body><div class='x'>" + "".join(f"<p>{t}</p>" for t in text.split("\n")) + "</div></body>"
    rows = [(i, f"http://c.org/{i}", page) for i in range(12)]
    assert {r.text for r in html.extract_main_text(spark.createDataFrame(rows, S)).collect()} == {text}


def test_classes_share_vectors(spark):
    t = html.templates(spark.createDataFrame([m[0] for m in host(30)], S)).first()
    assert t.region.endswith("div.a2") and any("/html/body/div.a2" in c.tokens and "/html/body/div.a1/ul" in c.tokens for c in t.classes)
    assert {f.split("#")[0].rsplit("/", 1)[1] for f in t.fixed} == {"div.q3", "p"}


@pytest.mark.parametrize("attributes", ["data-x=it's", "title='a > b' data-y=\"c > d\"", 'alt="x=\'y\'" data-z=\'q="r"\'', "a'b c\"d", "data-x = \"<p class='ad'>\""])
def test_quotes_in_attributes(attributes):
    assert html.main_text(f"<body><p {attributes}>one two</p><p>three</p></body>", "", frozenset()) == "one two\nthree"


def test_names_are_read_from_their_own_attributes():
    assert html.names_of(" data-x='class=ad' CLASS=\"wide\" id=main") == {"class": "wide", "id": "main"}
    assert html.main_text("<body><p title='class=ad'>one</p><div class=layout-wide><p>two</p></div></body>", "", frozenset()) == "one\ntwo"


@pytest.mark.parametrize("wrap", ["layout with-sidebar", "has-comments", "post-content ad-free"])
def test_layout_names_keep_the_article(wrap):
    assert html.main_text(f"<body><div class='{wrap}'><article><p>{prose(1, 30)}</p></article></div></body>", "", frozenset()) == prose(1, 30)


def test_distinct_hashes_of_a_bitmap():
    rng = random.Random(1)
    for n in (1, 2, 5, 12):
        bits = 0
        for _ in range(n):
            bits |= 1 << rng.randrange(64)
        assert abs(html.distinct(bits) - n) <= 0.35 * n + 0.5
    assert html.distinct((1 << 64) - 1) == html.distinct(-1) == float("inf")
