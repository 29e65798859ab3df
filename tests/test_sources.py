"""Files and feeds."""

import pytest

from tickerloom.operators.ordered import materialize
from tickerloom.sources import datasets, feeds, market


def test_market_dir(spark, tmp_path):
    (tmp_path / "600000.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,2,1,2,10\n2024-01-03,1,2,1,x,10\n2024-01-03,1,2,1,3,11\nbad,1,1,1,1,1\n")
    (tmp_path / "stock_list.csv").write_text("code,name\n1,a\n")
    raw = market.scan_market_dir(spark, str(tmp_path))
    assert {r.stock_code for r in raw.collect()} == {"600000"}
    got = market.standardize_ohlcv(raw).orderBy("trade_date").collect()
    assert [r.close for r in got][0] == 2.0 and len(got) == 2
    assert len(market.standardize_ohlcv(raw, 1).collect()) == 1
    inv = market.storage_inventory(spark, str(tmp_path)).first()
    assert inv.data_count == 4 and str(inv.latest_date) == "2024-01-03" and inv["size"] > 0
    with pytest.raises(ValueError):
        market.standardize_ohlcv(raw.drop("volume"))


def test_datasets(spark, tmp_path):
    df = spark.createDataFrame([("1", 2.0)], "stock_code string, x double")
    datasets.write_dataset(df, str(tmp_path), "a")
    assert datasets.read_dataset(spark, str(tmp_path), "a").first().x == 2.0
    (tmp_path / "b.csv").write_text("stock_code,x\n1,5\n")
    assert datasets.read_dataset(spark, str(tmp_path), "b").first().x == 5
    with pytest.raises(FileNotFoundError):
        datasets.read_dataset(spark, str(tmp_path), "c")
    assert materialize(df, "t").count() == 1


def test_json_feed_rules(spark):
    rows = [
        ('cb({"items":[{"title":"a","summary":"s","time":"t1","link":"u"},{"content":"no title"}]})',),
        ('[{"title":" b ","mediaName":"m"}]',),
        ("not json",),
    ]
    got = feeds.normalize_json_feed(spark.createDataFrame(rows, "payload string"), source_name="dflt", as_of="now").orderBy("title").collect()
    assert [tuple(r) for r in got] == [("a", "s", "t1", "dflt", "u"), ("b", "", "now", "m", "")]
    one = spark.createDataFrame([('{"d":{"x":{"t":"q"}}}',)], "payload string")
    r = feeds.normalize_json_feed(one, "d.x", {"title": ["zz", "t"], "source": {"value": "fixed"}, "url": {"path": "n", "default": "none"}}).first()
    assert (r.title, r.source, r.url) == ("q", "fixed", "none")


def test_xml_feed(spark):
    rss = "<rss><channel><item><title>A</title><pubDate>p</pubDate><guid>g</guid></item><item><description>x</description></item></channel></rss>"
    atom = "<feed><entry><title>B</title><summary>s</summary><link href='l'/></entry></feed>"
    got = feeds.normalize_feed_xml(spark.createDataFrame([(rss,), (atom,)], "xml string"), source_name="s0", as_of="now").orderBy("title").collect()
    assert [tuple(r) for r in got] == [("A", "", "p", "s0", "g"), ("B", "s", "now", "s0", "l")]


def test_listing_selectors(spark):
    items = "".join(f"<li class='x y'><a href='/20240101/{i}.shtml'>headline {i}</a><span class=list_time>2024-01-0{i}</span>" for i in range(1, 5))
    html = f"<html><body><ul class='head_news'>{items}</ul><li><a href='/other'>other page</a></li></body></html>"
    pages = spark.createDataFrame([(1, "https://n.com/list", html)], "page_id long, url string, html string")
    rows = feeds.extract_listing_html(pages, "ul.head_news li.x", {"publish_time": "span.list_time"}).orderBy("pos").collect()
    assert len(rows) == 4 and rows[0].url == "https://n.com/20240101/1.shtml" and rows[0].publish_time == "2024-01-01"
    best = feeds.score_listing_selectors(pages).first()
    assert (best.selector, best.unique_hit, best.date_hit) == ("ul.head_news li", 4, 4)
    assert best.title_selector == "a" and best.date_selector == "span.list_time"
    assert best.score == pytest.approx(4 + 0.35 * 4 + 0.02 * 4)


def test_bar_folders(spark, tmp_path):
    import datetime as dt

    bars = spark.createDataFrame(
        [(f"{k:06d}", dt.date(2024, 1, 1) + dt.timedelta(d), 1.0, 2.0, 0.5, 1.1 + d, 100.0) for k in range(5) for d in range(k + 1)],
        "stock_code string, trade_date date, open double, high double, low double, close double, volume double",
    )
    path = str(tmp_path / "bars")
    market.write_market_dir(bars, path)
    got = market.standardize_ohlcv(market.scan_market_dir(spark, path, folders=True))
    cols = ["stock_code", "trade_date", "open", "high", "low", "close", "volume"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, bars.select(*cols).collect()))
    inv = {r.stock_code: (r.data_count, str(r.latest_date), r["size"] > 0) for r in market.storage_inventory(spark, path, folders=True).collect()}
    assert inv == {f"{k:06d}": (k + 1, f"2024-01-0{k + 1}", True) for k in range(5)}
