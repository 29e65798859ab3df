"""Relative links against the standard library; item tags, namespaced fields and feed columns."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tickerloom.functions.codes import resolve_url
from tickerloom.sources import feeds

BASES = ["https://e.com/a/b/feed.xml?x=1#top", "https://e.com", "http://E.com:8080/", "https://e.com/a/b/", "//e.com/a/b", ""]
LINKS = ["", "c", "./c", "../c", "../../../c", "/c/d", "/c/../d/", "//o.org/x?y", "?q=1", "#f", "c?q#f", "..", ".", "c/..", "http://z.org/p", "mailto:a@b", "a/./b/../c/", "é漢/x y", " c "]


def test_links_resolve_like_the_library(spark):
    rows = [(b, r) for b in BASES for r in LINKS]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", resolve_url(F.col("b"), F.col("r")).alias("u")).collect()
    bad = [(x.b, x.r, x.u, urljoin(x.b, x.r.strip())) for x in got if x.u != urljoin(x.b, x.r.strip())]
    assert not bad
    assert spark.createDataFrame([(None, None)], "b string, r string").select(resolve_url(F.col("b"), F.col("r"))).first()[0] == ""


FEED = """<rss><channel><title>c</title><item><title>one</title><content:encoded>body</content:encoded><dc:date>2024-01-02</dc:date><link>/n/1</link></item>
<item><title>two</title><description>d</description><link href="p/2"/></item><item><title> </title></item></channel></rss>"""


def test_items_of_feeds(spark):
    df = spark.createDataFrame([(1, FEED, "https://a.com/f/rss.xml"), (2, FEED, None), (3, "<x/>", "u"), (4, None, "u")], "id int, xml string, feed string")
    got = sorted(map(tuple, feeds.normalize_feed_xml(df, feed_url=F.col("feed"), as_of="now").drop("feed").collect()))
    assert got == [
        (1, "one", "body", "2024-01-02", "", "https://a.com/n/1"),
        (1, "two", "d", "now", "", "https://a.com/f/p/2"),
        (2, "one", "body", "2024-01-02", "", "/n/1"),
        (2, "two", "d", "now", "", "p/2"),
    ]


@pytest.mark.parametrize("body", ["<news>{}</news>", "<items><news>{}</news></items>", "<channel><news>{}</news></channel>", "<channel><items><news>{}</news></items></channel>"])
def test_item_tag(spark, body):
    xml = f"<feed>{body.format('<title>t</title><guid>g/1</guid>')}<item><title>other</title></item></feed>"
    df = spark.createDataFrame([(xml,)], "xml string")
    got = feeds.normalize_feed_xml(df, item_tag="news", feed_url="http://h/a/").select("title", "url").collect()
    assert [tuple(r) for r in got] == [("t", "http://h/a/g/1")]


def test_bad_tag(spark):
    with pytest.raises(ValueError):
        feeds.normalize_feed_xml(spark.createDataFrame([("<a/>",)], "xml string"), item_tag="a b")
