"""Hostile and deep pages, spans of cells, visibility; and a second parser's words on whole tables of pages."""

import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from larkspur.llm import html


@pytest.mark.parametrize("start,first", [("--5", 1), ("²", 1), ("9" * 5000, 1), ("-3", -3), ("+4", 4), (" 7px", 7), ("", 1)])
def test_list_start(start, first):
    assert html.render(f'<ol start="{start}"><li>x</ol>') == f"{first}. x"


@pytest.mark.parametrize(
    "page",
    [
        "<table><tr><td>" * 1000 + "x", "<div>" * 100_000 + "x", "<p><button>" + "<div>" * 100_000 + "x", "<ul><li>" * 3000 + "x", "<blockquote>" * 20_000 + "x", "<b>" * 100_000 + "x", "<table>" * 50_000 + "x",
        "<a " + "'\"" * 50_000 + "x", "<a " + '"' * 99 + "x", "<a " * 50_000 + "x", "<a b=" * 50_000 + "x", "<!" * 100_000 + "x", "</a" * 100_000 + "x", "<script>" + "</script " * 50_000 + "x", "<" * 200_000 + "x", "<a x='" + '="' * 50_000 + "x",
        "<table>" + "<tr><td rowspan=65534>" * 2000 + "x</table>", "<table><tr>" + "<td colspan=1000>y" * 5000 + "</table>x", "<table>" + "<tr><td>y" * 30_000 + "</table>x", "&" * 100_000 + "x", "<li>" * 50_000 + "x", "<p>" * 50_000 + "x",
    ],
)
def test_time_and_depth(page):
    began = time.perf_counter()
    html.render(page)
    assert time.perf_counter() - began < 8


@pytest.mark.parametrize(
    "page,text",
    [
        ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab    c\n1  2  3"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td>1<td>2<tr><td colspan=2>a long one</table>", "1  2\na long one"),
        ("<table><tr><td colspan=0>a<td colspan=x>b</table>", "a  b"), ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"), ("<p style='VISIBILITY:collapse'>a</p>b", "b"), ("<p style='display:none'>a<b style='visibility:visible'>b</b></p>c", "c"),
        ("<table><tr><td style='visibility:hidden'>a<td>b</table>", "  b"), ("a<b", "a"), ("a < b", "a < b"), ('<a title=x"y>z</a>', "z"), ("<a title='>'>z</a>", "z"), ('<a href="u>v</a> w', "v w"), ("<p title=a title=b hidden=>x</p>y", "y"),
    ],
)
def test_shown(page, text):
    assert html.render(page) == text


class Words(HTMLParser):
    """The words of a page by the standard library's tokenizer; for pages without stray or hidden elements."""

    def __init__(self, page: str):
        super().__init__()
        self.skip, self.found = 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in html.HIDDEN

    def handle_endtag(self, tag):
        self.skip -= tag in html.HIDDEN

    def handle_data(self, data):
        if not self.skip:
            self.found += data.split()


def test_against_a_second_parser(spark):
    """Every visible word of all pages comes out, and no other: letters and digits are compared, markers aside."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    letters = lambda words: Counter(c for w in words for c in w if c.isalnum())
    for r in pages.collect():
        want, have = letters(Words(r.html).found), letters(got[r.page_id].split())
        extra = have - want
        assert not want - have and all(c.isdigit() for c in extra), r.page_id
