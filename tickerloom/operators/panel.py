"""The model panel: assembly, cleaning, feature groups, scope and readiness."""

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tickerloom.functions import defaults
from tickerloom.functions.maths import safe_float
from tickerloom.operators.calendar import available_dates

KEYS = ["stock_code", "trade_date"]


def assemble_panel(market: DataFrame, news_daily: DataFrame, static: DataFrame) -> DataFrame:
    """market left-joined with daily news and static features."""
    return market.join(news_daily, KEYS, "left").join(static, KEYS, "left")


def finalize_panel(df: DataFrame) -> DataFrame:
    """Fill sparse features with 0, drop rows without technicals or label, make the label int."""
    sparse = [
        c
        for c in df.columns
        if c in defaults.NEWS_COLUMNS or c.startswith(("sector_", "event_", "static_", "relevance_"))
    ]
    needed = defaults.TECHNICAL_COLUMNS + ["future_ret_5d", "label_up_5d"]
    return df.fillna(0, subset=sparse).dropna(subset=needed).withColumn("label_up_5d", F.col("label_up_5d").cast("int"))


def sort_panel(df: DataFrame) -> DataFrame:
    return df.orderBy("trade_date", "stock_code")


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def select_features(df: DataFrame, feature_set: str = "all_features") -> list[str]:
    """Feature column names: every numeric non-key column, or the technical ones."""
    if feature_set == "technical_only":
        return [c for c in defaults.TECHNICAL_COLUMNS if c in df.columns]
    return [c for c in _numeric(df) if c not in defaults.NON_FEATURES]


def feature_groups(df: DataFrame) -> dict[str, list[str]]:
    """Numeric columns by group: news, sector, tech, relevance."""
    cols = _numeric(df)
    events = sorted(c for c in cols if c.startswith("event_"))
    news = list(dict.fromkeys([c for c in defaults.NEWS_COLUMNS if c in cols] + events))
    return {
        "news": news,
        "sector": sorted(c for c in cols if c.startswith("sector_")),
        "tech": [c for c in defaults.TECHNICAL_COLUMNS if c in cols],
        "relevance": sorted(c for c in cols if c.startswith(("relevance_", "static_", "stock_sector_"))),
    }


def sanitize_features(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: safe_float(F.col(c)) for c in cols})


def restrict_scope(df: DataFrame, n_stocks: int = 0, days: int = 0) -> DataFrame:
    """Keep the n stocks with most rows and the last ``days`` distinct dates (0 = all)."""
    if n_stocks > 0:
        top = df.groupBy("stock_code").count().orderBy(F.col("count").desc(), "stock_code").limit(n_stocks)
        df = df.join(top.select("stock_code"), "stock_code", "left_semi")
    if days > 0:
        dates = df.select("trade_date").distinct().orderBy(F.col("trade_date").desc()).limit(days)
        df = df.join(dates, "trade_date", "left_semi")
    return df


def in_dates(df: DataFrame, dates: DataFrame, day: str = "trade_date") -> DataFrame:
    return df.join(dates.select(day).distinct(), day, "left_semi")


def lookup_with_default(df: DataFrame, dim: DataFrame, key: str, defaults_by_column: dict) -> DataFrame:
    """Left join with fallbacks for missing keys and values."""
    out = df.join(dim, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults_by_column.items()})


def daily_feature_lookup(df: DataFrame, code: str, trade_date: str | None = None, dates_limit: int = 60) -> DataFrame:
    """One stock's row of a date, or its latest row, with +available and +available_dates (its last ``dates_limit``).

    Where the date has no row, one row without features tells which dates there are; an unknown stock gives no row.
    """
    rows = df.filter(F.col("stock_code") == code)
    day = F.lit(trade_date).cast("date") if trade_date is not None else rows.agg(F.max("trade_date")).scalar()
    found = rows.filter(F.col("trade_date") == day).limit(1).withColumn("available", F.lit(True))
    out = available_dates(rows, dates_limit).join(found, "stock_code", "left")
    return out.select(*df.columns, F.coalesce("available", F.lit(False)).alias("available"), "available_dates")


def dataset_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, rows, stocks, first_date, last_date) of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(
            F.lit(name).alias("dataset"),
            F.count("*").alias("rows"),
            F.count_distinct("stock_code").alias("stocks"),
            F.min("trade_date").alias("first_date") if "trade_date" in df.columns else F.lit(None).cast("date").alias("first_date"),
            F.max("trade_date").alias("last_date") if "trade_date" in df.columns else F.lit(None).cast("date").alias("last_date"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def dataset_preview(df: DataFrame, limit: int = 5, preferred=("stock_code", "stock_name", "trade_date", "close", "news_count", "label_up_5d")) -> DataFrame:
    """First rows of the preferred columns, or of the first ten."""
    cols = [c for c in preferred if c in df.columns] or df.columns[:10]
    return df.select(*cols).limit(limit)


def feature_readiness(df: DataFrame, required: dict[str, list[str]] | None = None) -> DataFrame:
    """(grp, ready, missing, row_count, min_fill): which feature groups can be trained on.

    One scan counts the non-NULL values of every required column.
    """
    groups = required or {
        "news": ["news_count", "avg_sentiment", "weighted_sentiment", "news_impact_total"],
        "sector": [f"sector_{s}" for s in defaults.SECTOR_SLUGS.values()],
        "technical": defaults.TECHNICAL_COLUMNS,
        "relevance": ["relevance_mean", "relevance_max", "relevance_std", "relevance_strong_ratio"],
    }
    have = [c for cols in groups.values() for c in cols if c in df.columns]
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in dict.fromkeys(have)])
    rows = []
    for name, cols in groups.items():
        missing = [c for c in cols if c not in df.columns]
        present = [F.col(c) / F.col("_rows") for c in cols if c in df.columns]
        fill = F.array_min(F.array(*present)) if present else F.lit(0.0)
        rows.append(
            F.struct(
                F.lit(name).alias("grp"),
                F.lit(not missing).alias("ready"),
                F.lit(",".join(sorted(missing))).alias("missing"),
                F.col("_rows").alias("row_count"),
                fill.alias("min_fill"),
            )
        )
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def update_summary(stock: DataFrame, market: DataFrame, preview: int = 30) -> DataFrame:
    """Stocks with and without bars, the first codes without, and the latest trade date."""
    have = market.groupBy("stock_code").agg(F.max("trade_date").alias("_last"))
    state = stock.select("stock_code").distinct().join(have, "stock_code", "left")
    failed = (
        state.filter(F.col("_last").isNull()).orderBy("stock_code").limit(preview)
        .agg(F.array_join(F.sort_array(F.collect_list("stock_code")), ",")).scalar()
    )
    return state.agg(
        F.count("*").alias("total_stocks"),
        F.count("_last").alias("success_count"),
        F.count_if(F.col("_last").isNull()).alias("fail_count"),
        F.max("_last").alias("latest_trade_date"),
    ).withColumn("failed_codes_preview", failed)


def top_n(df: DataFrame, score: str, n: int, tie: str = "stock_code") -> DataFrame:
    return df.orderBy(F.col(score).desc(), tie).limit(n)


def top_k_per(df: DataFrame, group, score: str, k: int, tie: str = "stock_code") -> DataFrame:
    """Top k rows per group; Spark cuts each map task to k per group before the shuffle."""
    group = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_by_abs(df: DataFrame, col: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.abs(col).desc(), tie).limit(k)


def head(df: DataFrame, n: int, order) -> DataFrame:
    return df.orderBy(*([order] if isinstance(order, str) else order)).limit(n)


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def distinct_dates(df: DataFrame, col: str = "trade_date") -> DataFrame:
    return df.select(F.to_date(col).alias(col)).filter(F.col(col).isNotNull()).distinct()


def price_filter(df: DataFrame, lo: float, hi: float, col: str = "latest_price") -> DataFrame:
    return df.filter(F.col(col).between(lo, hi))


def stock_search(stock: DataFrame, q: str) -> DataFrame:
    """Case-insensitive search in code or name."""
    needle = F.lower(F.lit(q))
    return stock.filter(F.lower("stock_code").contains(needle) | F.lower("name").contains(needle))
