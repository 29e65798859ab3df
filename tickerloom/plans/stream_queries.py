"""Streaming queries over the events files."""

from pyspark.sql import functions as F

from tickerloom.plans import fixtures as fx
from tickerloom.plans.registry import query
from tickerloom.streaming import news as st
from tickerloom.streaming.run import run_available


def stream(spark, sf):
    """events as a file stream of news items."""
    schema = fx.table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    v = (F.col("value") - 50) / 50
    return e.select(
        F.substring(F.md5(F.col("event_id").cast("string")), 1, 12).alias("news_id"),
        F.lpad((F.col("user_id") % 10).cast("string"), 6, "0").alias("stock_code"),
        (F.col("ts").cast("timestamp") - F.expr("INTERVAL 8400 DAYS")).alias("publish_time"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)).alias("sentiment"),
    )


@query("j1_stream_news_dedupe", "SELECT DISTINCT news_id FROM fx_news")
def j1(spark, sf):
    """Every item arrives twice."""
    s = stream(spark, sf)
    return run_available(st.stream_news_dedupe(s.union(s)), "append", "j1").select("news_id")


@query("j2_stream_freshness", f"SELECT news_id FROM fx_news WHERE publish_time >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 300 HOUR")
def j2(spark, sf):
    return run_available(st.stream_freshness(stream(spark, sf), fx.as_of(), 300), "append", "j2").select("news_id")


BUCKETS = """SELECT lpad(CAST(user_id % 10 AS VARCHAR), 6, '0') AS stock_code,
    strftime(time_bucket(INTERVAL 1 DAY, ts - INTERVAL 8400 DAY - INTERVAL 1 MICROSECOND, TIMESTAMP '2001-01-01 15:00:00') + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS close_ts,
    count(*) AS news_count, avg(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 50))) AS avg_sentiment,
    sum(abs(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 50)))) AS news_sentiment_abs_sum FROM events GROUP BY 1, 2"""


BACK, AHEAD, SPAN = "60 days", "1 day", "61 days"


def recent(spark, sf):
    """Items of the two months before the evaluation time; the split keeps any other from moving the watermark."""
    return st.split_by_age(stream(spark, sf), fx.as_of(), BACK, AHEAD)[0]


@query("j3_stream_daily_news", BUCKETS, d="avg_sentiment news_sentiment_abs_sum", i="news_count")
def j3(spark, sf):
    return run_available(st.stream_daily_news(recent(spark, sf), SPAN), "update", "j3", ["stock_code", "close_ts"])


@query(
    "j3_stream_set_aside",
    """SELECT reason, count(*) AS n, min(news_id) AS first_id FROM (SELECT news_id, CASE WHEN publish_time > TIMESTAMP '2001-01-20 12:00:00' + INTERVAL 2 DAY THEN 'future'
    WHEN publish_time < TIMESTAMP '2001-01-20 12:00:00' - INTERVAL 9 DAY THEN 'stale' END AS reason FROM fx_news) WHERE reason IS NOT NULL GROUP BY 1""",
    i="n",
)
def j3_aside(spark, sf):
    """What a stream evaluated in the middle of the month sets aside, counted by reason."""
    aside = st.split_by_age(stream(spark, sf), F.lit("2001-01-20 12:00:00").cast("timestamp"), "9 days", "2 days")[1]
    return run_available(aside, "append", "j3-aside").groupBy("reason").agg(F.count("*").alias("n"), F.min("news_id").alias("first_id"))


@query(
    "j4_stream_effective_day",
    """SELECT news_id, trade_date FROM (SELECT news_id, lpad(CAST(user_id % 10 AS VARCHAR), 6, '0') AS s, publish_time FROM fx_news JOIN events ON event_id = arrival) n
    ASOF LEFT JOIN fx_cal c ON n.s = c.stock_code AND n.publish_time <= c.close_ts""",
    t="trade_date",
)
def j4(spark, sf):
    days = st.effective_days(fx.calendar(spark, sf))
    return run_available(st.stream_effective_day(stream(spark, sf), days), "append", "j4").select("news_id", "trade_date")


@query("j5_stream_shock_alert", f"SELECT * FROM ({BUCKETS}) WHERE news_count >= 8 OR abs(avg_sentiment) >= 0.45", d="avg_sentiment news_sentiment_abs_sum", i="news_count")
def j5(spark, sf):
    return st.shock_rows(run_available(st.stream_shock_alert(recent(spark, sf), SPAN), "update", "j5", ["stock_code", "close_ts"]))
