"""The static side of the stream of effective days."""

import datetime as dt
import random

from tickerloom.streaming import news as st


def test_trade_days_are_looked_up_by_block(spark):
    """The static side has a row per block of days, not one per day, and answers for every day."""
    draw, start = random.Random(1), dt.date(2001, 1, 1)
    held = {"a": sorted(draw.sample(range(1000), 60)), "b": [0, 2999], "c": [5]}
    days = spark.createDataFrame([(s, start + dt.timedelta(k)) for s, ks in held.items() for k in ks], "stock_code string, trade_date date")
    static = st.effective_days(days)
    assert static.count() <= 3 * len(held) + (1000 + 3000) / st.BLOCK
    items = [(s, k, dt.datetime(2001, 1, 1, 15) + dt.timedelta(k, late)) for s in "abcd" for k in (*range(-40, 1100, 3), 2998, 2999, 3000) for late in (0, 1)]
    items.append(("a", None, None))
    sdf = spark.createDataFrame(items, "stock_code string, k int, publish_time timestamp")
    got = st.stream_effective_day(sdf, static).collect()
    assert len(got) == len(items)
    for r in got:
        after = None if r.publish_time is None else r.k + (r.publish_time.second > 0)
        want = next((k for k in held.get(r.stock_code, []) if after is not None and k >= after), None)
        assert r.trade_date == (None if want is None else start + dt.timedelta(want)), r
