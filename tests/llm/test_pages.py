"""Main text of the driver's pages against a plain reading of their article elements."""

import os
from html.parser import HTMLParser

import pytest

from riskloom.llm import queries

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


class Article(HTMLParser):
    """All text inside ``article``, without scripts, styles and the furniture that may stand in it."""

    OUT = {"script", "style", "nav", "aside", "form", "header", "footer"}

    def __init__(self):
        super().__init__()
        self.inside, self.skipped, self.parts = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skipped += tag in self.OUT
        if self.inside and tag in ("p", "div", "br", "li", "h1", "h2", "h3", "td", "blockquote", "pre"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skipped -= tag in self.OUT

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.parts.append(data)


def test_every_page(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.op1_extract(spark, DATA).collect()}
    differ = []
    for i, page in html.items():
        plain = Article()
        plain.feed(page or "")
        plain.close()
        if "".join(plain.parts).split() != got[i].split():
            differ.append(i)
    assert not differ, (len(differ), differ[:5])
