"""Queries on the stock-sector graph and company dimension."""

from pyspark.sql import functions as F

from tickerloom.functions import codes
from tickerloom.operators import company as co, graph, news as nw, news_daily as nd, panel
from tickerloom.plans import fixtures as fx
from tickerloom.plans.registry import cte, query

cte("gr_prof", "SELECT stock_code, string_agg(sector || '=' || CAST(weight AS VARCHAR), '|' ORDER BY sector) AS prof FROM fx_edges GROUP BY 1")
cte(
    "gr_pairs",
    f"""SELECT code1, code2, {fx.half_up('a', 3)} AS corr FROM (SELECT x.stock_code AS code1, y.stock_code AS code2, avg((x.weight + y.weight) / 2) AS a
    FROM fx_edges x JOIN fx_edges y USING (sector) WHERE x.stock_code <> y.stock_code GROUP BY 1, 2)""",
)
@query(
    "c5_stock_pair_correlation",
    f"""SELECT p1, p2, {fx.half_up('avg(a)', 3)} AS corr, max(n1) AS n1, max(n2) AS n2 FROM (
    SELECT x.prof AS p1, y.prof AS p2, x.n AS n1, y.n AS n2, (ex.weight + ey.weight) / 2 AS a FROM (SELECT prof, min(stock_code) AS s, count(*) AS n FROM gr_prof GROUP BY 1) x
    JOIN fx_edges ex ON ex.stock_code = x.s JOIN fx_edges ey ON ey.sector = ex.sector JOIN (SELECT prof, min(stock_code) AS s, count(*) AS n FROM gr_prof GROUP BY 1) y ON ey.stock_code = y.s) GROUP BY 1, 2""",
    d="corr", i="n1 n2",
)
def c5(spark, sf):
    """The correlation matrix by distinct profiles, with the number of stocks of each profile."""
    e = fx.edges(spark, sf)
    as_text = lambda c: F.array_join(
        F.transform(F.from_json(c, "array<struct<sector string, weight double>>"), lambda e: F.concat(e["sector"], F.lit("="), e["weight"].cast("string"))), "|"
    )
    # written as text per stock, not per pair
    return graph.profile_pairs(e, graph.profiles(e).withColumn("profile", as_text("profile")))


cte(
    "gr_related",
    """SELECT * FROM (SELECT code1 AS stock_code, code2 AS code, corr, row_number() OVER (PARTITION BY code1 ORDER BY corr DESC, code2) AS rank
    FROM gr_pairs WHERE corr >= 0.3)""",
)


@query("c6_related_stocks", "SELECT r.stock_code, r.code, s.name, s.industry, corr, rank FROM gr_related r JOIN fx_stock s ON s.stock_code = r.code WHERE rank <= 10", d="corr", i="rank")
def c6(spark, sf):
    return graph.related_stocks(fx.edges(spark, sf), fx.stock_dim(spark, sf))


@query("c7_concept_stocks", "SELECT e.stock_code, name, weight AS relevance, industry FROM fx_edges e JOIN fx_stock USING (stock_code) WHERE e.sector = 'Brand#1'", d="relevance")
def c7(spark, sf):
    return graph.concept_stocks(fx.edges(spark, sf), fx.stock_dim(spark, sf), "Brand#1")


@query("c7_sector_members", "SELECT stock_code, name, industry, sector FROM fx_stock WHERE sector = 'ASIA' OR industry = 'ASIA'")
def c7b(spark, sf):
    return graph.sector_members(fx.company(spark, sf), "ASIA").select("stock_code", "name", "industry", "sector")


CENTER = "'000001'"
cte("gr_own", f"SELECT sector, weight FROM fx_edges WHERE stock_code = {CENTER}")
cte(
    "gr_first",
    f"""SELECT peer, sector, weight FROM (SELECT e.stock_code AS peer, e.sector, e.weight, row_number() OVER (PARTITION BY e.stock_code ORDER BY o.weight DESC, o.sector) AS r
    FROM gr_own o JOIN fx_edges e USING (sector) WHERE e.stock_code <> {CENTER}) WHERE r = 1""",
)


@query(
    "c8_graph_nodes",
    f"""SELECT {CENTER} AS center, stock_code AS id, name AS label, 'stock' AS type, industry FROM fx_stock WHERE stock_code = {CENTER} OR stock_code IN (SELECT peer FROM gr_first)
    UNION ALL SELECT {CENTER}, 'sector_' || sector, sector, 'sector', NULL FROM gr_own""",
)
def c8_nodes(spark, sf):
    dim = fx.stock_dim(spark, sf)
    return graph.graph_neighborhood(fx.edges(spark, sf), dim, dim.filter("stock_code = '000001'"))[0]


@query(
    "c8_graph_edges",
    f"""SELECT {CENTER} AS center, source, target, {fx.half_up('weight', 2)} AS weight FROM (
    SELECT {CENTER} AS source, sector AS target, weight FROM gr_own UNION ALL SELECT peer, sector, weight FROM gr_first)""",
    d="weight",
)
def c8_edges(spark, sf):
    dim = fx.stock_dim(spark, sf)
    return graph.graph_neighborhood(fx.edges(spark, sf), dim, dim.filter("stock_code = '000001'"))[1]


cte(
    "gr_news",
    "SELECT DISTINCT news_id, 'Brand#' || CAST(1 + (k * m) % 25 AS VARCHAR) AS sector, sw * sign(sentiment + 0.0001) AS impact FROM fx_news, (VALUES (1), (7)) t(m)",
)
cte("gr_direct", "SELECT news_id, stock_code AS code, sum(weight * impact) AS v FROM gr_news JOIN fx_edges USING (sector) GROUP BY 1, 2")
cte(
    "gr_indirect",
    """SELECT d.news_id, r.code, sum(r.corr * 0.5) AS v FROM gr_direct d JOIN gr_related r ON r.stock_code = d.code AND r.rank <= 5
    ANTI JOIN gr_direct x ON x.news_id = d.news_id AND x.code = r.code GROUP BY 1, 2""",
)


@query(
    "c9_news_propagation",
    f"""SELECT * FROM (SELECT news_id, kind, code, impact, row_number() OVER (PARTITION BY news_id, kind ORDER BY abs(impact) DESC, code) AS rank FROM (
    SELECT news_id, 'direct' AS kind, code, {fx.half_up('v', 3)} AS impact FROM gr_direct UNION ALL SELECT news_id, 'indirect', code, {fx.half_up('v', 3)} FROM gr_indirect)) WHERE rank <= 10""",
    d="impact", i="rank",
)
def c9(spark, sf):
    k = F.get_json_object("content", "$.k").cast("int")
    sign = F.signum(F.col("sentiment") + 0.0001)
    w = F.when(k % 2 == 0, 0.8).otherwise(0.5)
    brand = lambda m: F.concat(F.lit("Brand#"), (1 + (k * m) % 25).cast("string"))
    rows = (
        fx.news(spark, sf)
        .select("news_id", (w * sign).alias("impact"), F.explode(F.array_distinct(F.array(brand(1), brand(7)))).alias("sector"))
    )
    return graph.news_propagation(rows, fx.edges(spark, sf), fx.stock_dim(spark, sf))


cte("gr_rows", "SELECT a.stock_code, coalesce(p.corr, 0.0::DOUBLE) AS c FROM fx_stock a JOIN fx_stock b ON a.stock_code <> b.stock_code LEFT JOIN gr_pairs p ON p.code1 = a.stock_code AND p.code2 = b.stock_code")
cte(
    "gr_summary",
    """SELECT stock_code, avg(c) AS relevance_mean, max(c) AS relevance_max, stddev_pop(c) AS relevance_std,
    avg(CASE WHEN c > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS relevance_strong_ratio FROM gr_rows GROUP BY 1""",
)
REL = "relevance_mean relevance_max relevance_std relevance_strong_ratio"


@query("d7b_relevance_summary", "SELECT * FROM gr_summary", d=REL)
def d7b(spark, sf):
    return graph.relevance_summary(fx.edges(spark, sf), fx.stock_dim(spark, sf).select("stock_code"))


cte(
    "gr_vec",
    """SELECT stock_code, list_concat([avg(c), 1.0::DOUBLE, stddev_pop(c), avg(CASE WHEN c > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), avg(CASE WHEN c > 0.7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)],
    list_resize(list_slice(list(c ORDER BY c DESC), 1, 10), 11, 0.0::DOUBLE)) AS relevance FROM (SELECT * FROM gr_rows UNION ALL SELECT stock_code, 1.0::DOUBLE FROM fx_stock) GROUP BY 1""",
)


@query("d30_encode_relevance_features", "SELECT stock_code, generate_subscripts(relevance, 1) - 1 AS pos, unnest(relevance) AS value FROM gr_vec", d="value", i="pos")
def d30(spark, sf):
    v = graph.encode_relevance_features(fx.edges(spark, sf), fx.stock_dim(spark, sf).select("stock_code"))
    return v.select("stock_code", F.posexplode("relevance").alias("pos", "value"))


@query("c18_relevance_lookup", "SELECT c.code AS stock_code, coalesce(v.relevance[1], 0.0::DOUBLE) AS mean FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code FROM customer) c LEFT JOIN gr_vec v ON v.stock_code = c.code", d="mean")
def c18(spark, sf):
    """Customers stand in for a stock list that is partly outside the graph."""
    vectors = graph.encode_relevance_features(fx.edges(spark, sf), fx.stock_dim(spark, sf).select("stock_code"))
    listed = fx.table(spark, sf, "customer").select(codes.pad_code(F.col("c_custkey")).alias("stock_code"))
    return graph.relevance_lookup(listed, vectors).select("stock_code", F.element_at("relevance", 1).alias("mean"))


@query(
    "d13_sector_heatmap",
    f"""SELECT s.sector, coalesce(n, 0) AS stock_count, coalesce({fx.half_up('a', 3)}, 0.0::DOUBLE) AS avg_relevance, coalesce(top, '') AS top_stocks FROM (SELECT DISTINCT p_brand AS sector FROM part UNION ALL SELECT 'none') s
    LEFT JOIN (SELECT sector, count(*) AS n, avg(weight) AS a, string_agg(stock_code, ',' ORDER BY r) FILTER (WHERE r <= 5) AS top FROM (
    SELECT *, row_number() OVER (PARTITION BY sector ORDER BY weight DESC, stock_code) AS r FROM fx_edges) GROUP BY 1) USING (sector)""",
    d="avg_relevance", i="stock_count",
)
def d13(spark, sf):
    listed = fx.table(spark, sf, "part").select(F.col("p_brand").alias("sector")).distinct()
    listed = listed.unionByName(spark.range(1).select(F.lit("none").alias("sector")))
    return graph.sector_heatmap(fx.edges(spark, sf), listed).withColumn("top_stocks", F.array_join("top_stocks", ","))


STATIC = {"ASIA": "asia", "EUROPE": "europe", "A": "a"}
cte(
    "st_daily",
    """SELECT c.stock_code, c.trade_date, CAST(coalesce(len(concepts), 0) AS DOUBLE) AS static_concept_count, CAST(date_diff('day', listing_date, c.trade_date) AS DOUBLE) AS static_listing_days,
    relevance_mean, relevance_max, relevance_std, relevance_strong_ratio, """
    + ", ".join(f"CASE WHEN contains(sector || ' ' || industry, '{k}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS stock_sector_{v}" for k, v in STATIC.items())
    + " FROM fx_cal c JOIN fx_company USING (stock_code) JOIN gr_summary USING (stock_code)",
)
STATIC_COLS = ["static_concept_count", "static_listing_days", *REL.split(), *[f"stock_sector_{v}" for v in STATIC.values()]]


def static(spark, sf, days=None):
    days = fx.calendar(spark, sf) if days is None else days
    rel = graph.relevance_summary(fx.edges(spark, sf), fx.stock_dim(spark, sf).select("stock_code"))
    return nd.static_daily(days, fx.company(spark, sf, days), rel, STATIC)


@query("b26_static_daily", f"SELECT stock_code, trade_date, {', '.join(STATIC_COLS)} FROM st_daily", d=" ".join(STATIC_COLS), t="trade_date")
def q_static(spark, sf):
    return static(spark, sf)


@query(
    "b45_company_profile",
    """SELECT stock_code, CASE WHEN list_contains(concepts, 'Brand#1') OR list_contains(concepts, 'Brand#2') THEN '龙头' WHEN s_nationkey % 3 < 2 THEN '主流' ELSE '一般' END AS position,
    CASE WHEN s_nationkey % 3 = 0 THEN '信用风险,利率风险' ELSE '市场波动风险' END AS risks,
    CASE WHEN list_contains(concepts, 'Brand#3') THEN '较高' ELSE '中等' END AS potential,
    CASE WHEN list_contains(concepts, 'Brand#3') THEN '消费升级趋势' ELSE '行业自然增长' END AS drivers
    FROM fx_company JOIN supplier ON s_suppkey = CAST(stock_code AS BIGINT)""",
)
def b45(spark, sf):
    """Suppliers with brands and nations renamed to the terms of the rules."""
    names = {"Brand#1": "行业龙头", "Brand#2": "领涨股", "Brand#3": "消费升级"}
    swap = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    renamed = F.transform("concepts", lambda x: F.coalesce(F.try_element_at(swap, x), x))
    nation = fx.table(spark, sf, "supplier").select(codes.pad_code(F.col("s_suppkey")).alias("stock_code"), (F.col("s_nationkey") % 3).alias("_k"))
    industry = F.when(F.col("_k") == 0, "银行").when(F.col("_k") == 1, "保险").otherwise("零售")
    c = fx.company(spark, sf).join(nation, "stock_code").withColumns({"concepts": renamed, "industry": industry})
    return co.company_profile(c).select(
        "stock_code", "position", F.array_join("risks", ",").alias("risks"), "potential", F.array_join("drivers", ",").alias("drivers")
    )


@query(
    "c16_lookup_with_default",
    "SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS stock_code, coalesce(s.name, 'n/a') AS name, coalesce(s.industry, 'unknown') AS industry FROM customer LEFT JOIN fx_stock s ON s.stock_code = lpad(CAST(c_custkey AS VARCHAR), 6, '0')",
)
def c16(spark, sf):
    listed = fx.table(spark, sf, "customer").select(codes.pad_code(F.col("c_custkey")).alias("stock_code"))
    dim = fx.stock_dim(spark, sf).select("stock_code", "name", "industry")
    return panel.lookup_with_default(listed, dim, "stock_code", {"name": "n/a", "industry": "unknown"})


@query("b55_stock_search", "SELECT stock_code, name FROM fx_stock WHERE contains(stock_code, '07') OR contains(lower(name), '07')")
def b55(spark, sf):
    return panel.stock_search(fx.stock_dim(spark, sf).select("stock_code", "name"), "07")


@query(
    "e24_recent_periods",
    """SELECT stock_code, strftime(period, '%Y-%m-%d') AS period, round(sum(CASE WHEN item = 'O' THEN value ELSE 0 END), 2) AS o FROM (
    SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS stock_code, date_trunc('quarter', o_orderdate) AS period, o_orderstatus AS item, sum(o_totalprice) AS value,
    dense_rank() OVER (PARTITION BY o_custkey ORDER BY date_trunc('quarter', o_orderdate) DESC) AS r FROM orders GROUP BY o_custkey, date_trunc('quarter', o_orderdate), o_orderstatus) WHERE r <= 4 GROUP BY 1, 2""",
    d="o",
)
def e24(spark, sf):
    """Quarterly order totals per customer by status, as a report table."""
    o = fx.table(spark, sf, "orders")
    rep = o.groupBy(
        codes.pad_code(F.col("o_custkey")).alias("stock_code"), F.to_date(F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp"))).alias("period"), F.col("o_orderstatus").alias("item")
    ).agg(F.sum("o_totalprice").alias("value"))
    r = nw.recent_periods(rep)
    return r.select("stock_code", "period", F.round(F.coalesce(F.try_element_at("ratios", F.lit("O")), F.lit(0.0)), 2).alias("o"))


@query(
    "e24_company_announcements",
    """SELECT * FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS stock_code, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, o_orderpriority AS title, o_orderstatus AS type,
    strftime(o_orderdate, '%Y-%m-%d') AS date, 'o/' || CAST(o_orderkey AS VARCHAR) AS url FROM orders) WHERE place <= 20""",
    i="place",
)
def e24_announcements(spark, sf):
    """Orders as announcements of their customers, in order of their numbers."""
    o = fx.table(spark, sf, "orders")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    listed = o.select(codes.pad_code(F.col("o_custkey")).alias("stock_code"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("type"), day.alias("date"), F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("url"))
    return nw.company_announcements(listed)


@query(
    "e24_research_reports",
    """SELECT * FROM (SELECT lpad(CAST(o_custkey % 50 AS VARCHAR), 6, '0') AS stock_code, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS place, 'r' || CAST(o_orderkey AS VARCHAR) AS title,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS institution, o_orderstatus AS rating, strftime(o_orderdate, '%Y-%m-%d') AS date, '' AS author FROM orders) WHERE place <= 10""",
    i="place",
)
def e24_reports(spark, sf):
    """Orders as reports on fifty busy companies; some name no institution, none an author."""
    o = fx.table(spark, sf, "orders")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    house = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    listed = o.select(codes.pad_code(F.col("o_custkey") % 50).alias("stock_code"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("title"), house.alias("institution"), F.col("o_orderstatus").alias("rating"), day.alias("date"))
    return nw.research_reports(listed)


@query(
    "b_codes",
    """SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS pad, CASE WHEN length(d) > 6 THEN right(d, 6) ELSE lpad(d, 6, '0') END AS digits,
    CASE WHEN starts_with(d, '6') THEN 'sh' ELSE 'sz' END || d AS exchange, regexp_matches(d, '^[0-9]{6}$') AS valid,
    trim(regexp_replace(lower(c_name), '[^a-z0-9_-]+', '_', 'g'), '_') AS slug FROM (SELECT *, regexp_replace(c_name, '\\D', '', 'g') AS d FROM customer)""",
)
def b_codes(spark, sf):
    """B1-B4 and B12."""
    c = fx.table(spark, sf, "customer")
    d = F.regexp_replace("c_name", r"\D", "")
    return c.select(
        "c_custkey",
        codes.pad_code(F.col("c_custkey")).alias("pad"),
        codes.digits_code(F.col("c_name")).alias("digits"),
        codes.exchange_code(d).alias("exchange"),
        codes.valid_code(d).alias("valid"),
        codes.slug(F.col("c_name")).alias("slug"),
    )


@query(
    "b9_strip_company_suffix",
    "SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name, '(.)widget$', '\\1'), '(.)bolt$', '\\1')) AS stem FROM part",
)
def b9(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", codes.strip_company_suffix(F.col("p_name"), ["widget", "bolt"]).alias("stem"))


@query(
    "b13_resolve_source",
    """SELECT doc_id, CASE WHEN source IN ('src1', 'src2', 'src3') THEN source WHEN source = 'src4' THEN 'src1' WHEN source = 'src5' THEN 'src3' WHEN source = 'src6' THEN 'all' ELSE 'src2' END AS source_id FROM documents""",
)
def b13(spark, sf):
    """src4 is a display name of src1, src5 an alias of src3; src2 is the default."""
    dim = spark.createDataFrame(
        [("src1", "SRC4", True, 2), ("src2", "two", True, 1), ("src3", "three", False, 0)], "source_id string, name string, enabled boolean, sort_order int"
    )
    alias = spark.createDataFrame([("src5", "src3"), ("gone", "src9")], "alias string, target string")
    d = fx.table(spark, sf, "documents").select("doc_id", F.when(F.col("source") == "src6", "ALL").otherwise(F.col("source")).alias("source"))
    return codes.resolve_source(d, dim, alias).select("doc_id", "source_id")
