"""First announcements and reports: order of the source, ties, nulls, missing fields, empty tables."""

from tickerloom.operators import news


def test_first_entries(spark):
    rows = [("1", k, f"t{k % 3}" if k != 5 else None, "x") for k in (9, 5, 7, 1, 1)] + [("2", None, "late", None), ("2", 3, "a", None), (None, 1, "b", "y")]
    df = spark.createDataFrame(rows, "stock_code string, seq int, title string, rating string")
    got = sorted((r.stock_code or "", r.place, r.title, r.rating, r.author) for r in news.research_reports(df, 3).collect())
    assert got == [("", 1, "b", "y", ""), ("1", 1, "t1", "x", ""), ("1", 2, "t1", "x", ""), ("1", 3, "", "x", ""), ("2", 1, "a", "", ""), ("2", 2, "late", "", "")]
    assert news.company_announcements(df, 1).columns == ["stock_code", "place", "title", "type", "date", "url"]
    assert news.company_announcements(df.limit(0)).count() == 0
