"""Daily news statistics in one pass against the single operators; exponential means without gaps against pandas."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import news_daily as nd
from tickerloom.operators.ewm import dense_ewm, ewm

R = random.Random(5)
DAYS = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(40)]
SECTORS = {"bank": "b", "car": "c", "none": "n"}
EVENTS = {"deal": "deal", "x": "x"}


@pytest.fixture(scope="module")
def frames(spark):
    rows = []
    for _ in range(700):
        day = R.choice(DAYS)
        sectors = {s: R.choice([0.5, 0.8, None]) for s in R.sample(["bank", "car", "air", "sea"], R.randint(0, 3))}
        rows.append(
            (
                R.choice(["000001", "000002"]),
                day,
                dt.datetime.combine(day, dt.time(R.randint(0, 15))),
                R.choice([-1.0, -0.3, 0.0, 0.25, 0.9, None, float("nan")]),
                R.choice([0.5, 0.7, 1.0, None]),
                R.choice(["a", " a", "b", "", None, "c"]),
                R.choice(["a deal", "x", None]),
                R.choice(["deal and x", "", None]),
                R.choice([sectors, None, {}]),
            )
        )
    items = spark.createDataFrame(
        rows,
        "stock_code string, trade_date date, publish_time timestamp, sentiment double, importance double, source string, title string, content string, affected_sectors map<string,double>",
    )
    calendar = spark.createDataFrame([(c, d) for c in ("000001", "000002", "000003") for d in DAYS], "stock_code string, trade_date date")
    return items, calendar


def as_rows(df, cols):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=str)


def test_one_pass_equals_the_single_operators(frames):
    items, calendar = frames
    got = nd.daily_stats(items, SECTORS, EVENTS).fillna(0)
    base = nd.news_daily_base(items, items.select(*nd.KEYS).distinct())
    parts = [base, nd.source_stats(items), nd.sector_scores(items, SECTORS), nd.event_counts(items, EVENTS)]
    want = parts[0]
    for p in parts[1:]:
        want = want.join(p, nd.KEYS, "left")
    want = want.fillna(0)
    assert set(got.columns) == set(want.columns)
    assert as_rows(got, sorted(got.columns)) == as_rows(want, sorted(got.columns))


def test_all_days_have_features(frames):
    items, calendar = frames
    daily = nd.news_daily_features(items, calendar, SECTORS, EVENTS)
    assert daily.count() == calendar.count()
    quiet = daily.filter("stock_code = '000003'").agg(F.max("news_count"), F.max("sentiment_ewm_3d"), F.max("event_shock_flag")).first()
    assert tuple(quiet) == (0, 0.0, 0.0)
    assert nd.news_daily_features(items.limit(0), calendar, SECTORS, EVENTS).count() == calendar.count()


@pytest.mark.parametrize("spans", [(1.05, 3, 5), (3, 400), (12, 26, 250), (2, 30, 900)])
def test_dense_means_equal_pandas(spark, spans):
    rows = [(k, i, R.gauss(0, 50) * 10 ** R.randint(-3, 3)) for k in ("a", "b") for i in range(2600 if k == "a" else 1)]
    df = spark.createDataFrame(rows, "stock_code string, trade_date int, v double")
    got = dense_ewm(df, {"v": [(f"m{n}", s) for n, s in enumerate(spans)]}).toPandas().sort_values(["stock_code", "trade_date"])
    for n, s in enumerate(spans):
        want = pd.concat([g.sort_values("trade_date").v.ewm(span=s, adjust=False).mean() for _, g in got.groupby("stock_code")])
        assert (got[f"m{n}"] - want).abs().max() <= 1e-9 * got.v.abs().max()


def test_dense_means_refuse_gaps(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None)], "stock_code string, trade_date int, v double")
    with pytest.raises(Exception, match="holds a NULL"):
        dense_ewm(df, {"v": [("m", 3)]}).collect()
    assert ewm(df, {"v": [("m", 3)]}).count() == 2
