"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = [
    "entry_momentum_topk",
    "e_technical_panel",
    "e4_ewm",
    "c2_align_news",
    "news_daily_features",
    "b34_b37_sentiment",
    "c4_match_news_to_stocks",
    "g5_multi_key_dedupe",
    "b43_b44_news_impact",
    "d7b_relevance_summary",
    "b49_finalize_panel",
    "c13_sample_replay",
    "d16_roc_auc_panel",
    "d22_backtest_summary",
    "d28_encode_text_hash",
    "h16_batch_recommend",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickerloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tickerloom.plans import load

    queries, _ = load()
    spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
