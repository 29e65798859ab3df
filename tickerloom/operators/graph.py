"""Stock-sector graph: correlations, neighbours, propagation.

The correlation of two stocks is the mean of their weights over the sectors that both hold, so whom a stock
meets on exactly the sectors S, and with which sum of weights, decides everything. Summaries need no pairs: stocks are
counted per subset of the sectors they hold (few per stock, 2^k subsets), and inclusion and exclusion over the larger
subsets gives, for every set of sectors A and each S within it, how many stocks share exactly S with it. The work is
linear in the number of stocks, also where one sector holds half of them. Lists of neighbours read the first codes of
these groups. The pair list itself is built only on request.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.functions.maths import round_half_up
from tickerloom.operators.ordered import materialize

UNIT = 1_000_000  # weights count to six places
MOST_SECTORS = 16  # of one stock; more raise an error, since 2^k subsets are counted


def profiles(edges: DataFrame) -> DataFrame:
    """(stock_code, profile) with the profile a canonical text of sectors and weights."""
    return edges.groupBy("stock_code").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("sector", "weight")))).alias("profile")
    )


SLICES = 16  # parts into which the meetings of one sector are cut


def profile_pairs(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(p1, p2, corr, n1, n2) of profiles that share a sector, both directions and p1 = p2, with their numbers of stocks.

    Two profiles meet in every sector they share and make their row in the first of them, from the weights that both
    bring along, so no row is shuffled after the meeting. Tasks are dealt by number: few profiles make many pairs, and
    adaptive execution, which sees the profiles only, would join them into one task.
    """
    size = members.groupBy("profile").agg(F.min("stock_code").alias("stock_code"), F.count("*").alias("n"))
    held = edges.join(size, "stock_code").filter("sector is not null").groupBy("profile").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("sector", "weight"))).alias("held"), F.collect_set("sector").alias("in")
    )
    side = lambda k: held.select(F.col("profile").alias(f"p{k}"), F.col("n").alias(f"n{k}"), F.col("held").alias(f"h{k}"), F.col("in").alias(f"in{k}"), F.explode("in").alias("sector"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = side(1).withColumn("slice", F.pmod(F.hash("p1"), F.lit(SLICES))).repartition(parts, "sector", "slice")
    b = side(2).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).repartition(parts, "sector", "slice")
    met = a.join(b, ["sector", "slice"]).filter(F.col("sector") == F.array_min(F.array_intersect("in1", "in2")))
    both = lambda x: F.transform(F.filter("h2", lambda y: y["sector"] == x["sector"]), lambda y: (x["weight"] + y["weight"]) / 2)
    means = F.array_compact(F.flatten(F.transform("h1", both)))
    mean = F.try_divide(F.aggregate(means, F.lit(0.0), lambda s, x: s + x), F.size(means))
    return met.select("p1", "p2", round_half_up(mean, 3).alias("corr"), "n1", "n2")


def stock_pair_correlation(edges: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """(code1, code2, corr) of stocks that share a sector; absent pairs are 0.

    The pair list is the result itself; with ``codes`` only those stocks take part.
    """
    used = edges if codes is None else edges.join(codes, "stock_code", "left_semi")
    members = profiles(used)
    m1 = members.select(F.col("stock_code").alias("code1"), F.col("profile").alias("p1"))
    m2 = members.select(F.col("stock_code").alias("code2"), F.col("profile").alias("p2"))
    return (
        profile_pairs(used, members)
        .join(m1, "p1")
        .join(m2, "p2")
        .filter("code1 <> code2")
        .select("code1", "code2", "corr")
    )


def _subsets(held: str) -> Column:
    """Every non-empty subset of an array column, as one mask of bits per row."""
    k = F.size(held)
    few = F.when(k <= MOST_SECTORS, k).otherwise(F.raise_error(F.lit(f"a stock holds more than {MOST_SECTORS} sectors")).cast("int"))
    return F.explode(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), few) - 1))


def _chosen(held: str, mask: str) -> Column:
    return F.filter(held, lambda x, i: F.getbit(F.col(mask), i) == 1)


def _sectors(held: Column) -> Column:
    return F.transform(held, lambda x: x["sector"])


def _weight_on(held: Column, sectors: Column | None = None) -> Column:
    """Weight in millionths over the listed sectors, or over all."""
    on = held if sectors is None else F.filter(held, lambda x: F.array_contains(sectors, x["sector"]))
    return F.aggregate(on, F.lit(0).cast("long"), lambda s, x: s + x["u"])


def _correlation(total: Column, shared: Column) -> Column:
    """Both sides' weight over the shared sectors as their mean, half up to three places, in whole units."""
    return F.floor((total * 1000 + shared * UNIT) / (shared * (2 * UNIT))) / 1000.0


def holdings(edges: DataFrame) -> DataFrame:
    """(stock_code, held): a stock's sectors with weights in millionths, sorted; written once, as several passes read it."""
    unit = F.round(F.col("weight") * UNIT).cast("long")
    return materialize(edges.groupBy("stock_code").agg(F.sort_array(F.collect_list(F.struct("sector", unit.alias("u")))).alias("held")), "holdings")


def _kinds(held: DataFrame) -> DataFrame:
    """(held, kind, n): stocks of equal sectors and weights, named by their first code."""
    return held.groupBy("held").agg(F.min("stock_code").alias("kind"), F.count("*").alias("n"))


def exact_meetings(held: DataFrame) -> DataFrame:
    """(a, s, w, n): n stocks share exactly the sectors s with a stock that holds the sectors a, and weigh w there.

    Stocks with s and weight w on it, counted once per superset u of s that they hold, enter with the sign of the
    sectors that u has beyond s; over all u within a only the stocks without further common sectors remain.
    """
    part = held.select("held", _subsets("held").alias("m")).groupBy(_chosen("held", "m").alias("held")).agg(F.count("*").alias("n"))
    inner = part.select("held", "n", _subsets("held").alias("m")).select("held", "n", _chosen("held", "m").alias("on"))
    sign = F.when((F.size("held") - F.size("on")) % 2 == 0, F.col("n")).otherwise(-F.col("n"))
    counts = inner.groupBy(_sectors(F.col("held")).alias("u"), _sectors(F.col("on")).alias("s"), _weight_on(F.col("on")).alias("w")).agg(F.sum(sign).alias("n"))
    sets = held.select(_sectors(F.col("held")).alias("a")).distinct()
    within = sets.select("a", _subsets("a").alias("m")).select("a", _chosen("a", "m").alias("u"))
    return within.join(counts, "u").groupBy("a", "s", "w").agg(F.sum("n").alias("n")).filter("n > 0")


def _groups(kinds: DataFrame, meetings: DataFrame) -> DataFrame:
    """(kind, a, s, w, n, corr): for each kind its groups of stocks, itself among them."""
    met = kinds.select("kind", "held", _sectors(F.col("held")).alias("a")).join(meetings, "a")
    total = _weight_on(F.col("held"), F.col("s")) + F.col("w")
    return met.select("kind", "a", "s", "w", "n", _correlation(total, F.size("s")).alias("corr"))


def _peer_values(edges: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (stock_code, kind) and, per kind, (kind, corr, n): how many other stocks have that correlation with it."""
    held = holdings(edges.join(codes.select("stock_code"), "stock_code", "left_semi"))
    kinds = _kinds(held)
    itself = kinds.select("kind", _correlation(2 * _weight_on(F.col("held")), F.size("held")).alias("corr"), F.lit(-1).cast("long").alias("n"))
    values = _groups(kinds, exact_meetings(held)).select("kind", "corr", "n").union(itself).groupBy("kind", "corr").agg(F.sum("n").alias("n")).filter("n > 0")
    return held.join(kinds.select("held", "kind"), "held").select("stock_code", "kind"), values


def relevance_summary(edges: DataFrame, codes: DataFrame) -> DataFrame:
    """Mean, max, population std and share above 0.5 of the correlation with all other stocks."""
    members, values = _peer_values(edges, codes)
    n = codes.agg(F.count("*")).scalar()
    c, k = F.col("corr"), F.col("n")
    sums = values.groupBy("kind").agg(
        F.sum(c * k).alias("_s"),
        F.sum(c * c * k).alias("_q"),
        F.max(c).alias("_m"),
        F.sum(F.when(c > 0.5, k).otherwise(0)).alias("_h"),
    )
    per = members.join(sums, "kind").select("stock_code", "_s", "_q", "_m", "_h")
    peers = F.col("_peers")
    mean = F.col("_s") / peers
    out = codes.select("stock_code").join(per, "stock_code", "left").withColumn("_peers", n - 1)
    some = lambda v: F.coalesce(F.when(peers > 0, v), F.lit(0.0))
    return out.select(
        "stock_code",
        some(mean).alias("relevance_mean"),
        some(F.greatest(F.col("_m"), F.lit(0.0))).alias("relevance_max"),
        some(F.sqrt(F.greatest(F.col("_q") / peers - mean * mean, F.lit(0.0)))).alias("relevance_std"),
        some(F.col("_h") / peers).alias("relevance_strong_ratio"),
    )


def _relevance_vectors(listed: DataFrame, members: DataFrame, values: DataFrame, n: Column, width: int) -> DataFrame:
    """(stock_code, relevance array) of the listed stocks: row statistics including the stock itself, then the top 10."""
    c, k = F.col("corr"), F.col("n")
    highest = F.slice(F.sort_array(F.collect_list(F.struct("corr", "n")), asc=False), 1, 9)  # of 1,001 values at most
    per = values.groupBy("kind").agg(
        F.sum(c * k).alias("_s"),
        F.sum(c * c * k).alias("_q"),
        F.sum(F.when(c > 0.5, k).otherwise(0)).alias("_h5"),
        F.sum(F.when(c > 0.7, k).otherwise(0)).alias("_h7"),
        highest.alias("_t"),
    )
    repeated = F.flatten(F.transform("_t", lambda t: F.array_repeat(t["corr"], F.least(t["n"], F.lit(9)).cast("int"))))
    per = members.join(per.withColumn("_top", F.slice(repeated, 1, 9)), "kind")
    z = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    mean = (z("_s") + 1.0) / F.col("_n")
    stats = F.array(
        mean,
        F.lit(1.0),
        F.sqrt(F.greatest((z("_q") + 1.0) / F.col("_n") - mean * mean, F.lit(0.0))),
        (z("_h5") + 1.0) / F.col("_n"),
        (z("_h7") + 1.0) / F.col("_n"),
    )
    # the stock itself leads the sorted row with 1.0; missing peers are zeros
    row = F.concat(
        F.array(F.lit(1.0)), F.coalesce("_top", F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), 9)
    )
    vec = F.concat(stats, F.slice(row, 1, 10), F.array_repeat(F.lit(0.0), width))
    return (
        listed.select("stock_code")
        .join(per.select("stock_code", "_s", "_q", "_h5", "_h7", "_top"), "stock_code", "left")
        .withColumn("_n", n)
        .select("stock_code", F.slice(vec, 1, width).alias("relevance"))
    )


def encode_relevance_features(edges: DataFrame, codes: DataFrame, width: int = 16) -> DataFrame:
    """(stock_code, relevance array): row statistics including the stock itself, then the top 10."""
    members, values = _peer_values(edges, codes)
    return _relevance_vectors(codes, members, values, codes.agg(F.count("*")).scalar(), width)


def encode_relevance_of(code: str, edges: DataFrame, codes: DataFrame, width: int = 16) -> DataFrame:
    """The relevance vector of one stock, outward from its own sectors: only edges of those sectors are read on."""
    own = edges.filter(F.col("stock_code") == code).select("sector", F.col("weight").alias("_w"))
    near = edges.filter(F.col("stock_code") != code).join(F.broadcast(own), "sector").join(codes.select("stock_code"), "stock_code", "left_semi")
    unit = lambda c: F.round(F.col(c) * UNIT).cast("long")
    met = near.groupBy("stock_code").agg(F.sum(unit("weight") + unit("_w")).alias("total"), F.count("*").alias("shared"))
    values = met.groupBy(_correlation(F.col("total"), F.col("shared")).alias("corr")).agg(F.count("*").alias("n")).select(F.lit(code).alias("kind"), "corr", "n")
    listed = codes.filter(F.col("stock_code") == code)
    members = listed.select("stock_code", F.col("stock_code").alias("kind"))
    return _relevance_vectors(listed, members, values, codes.agg(F.count("*")).scalar(), width)


def relevance_lookup(df: DataFrame, relevance: DataFrame) -> DataFrame:
    """Attach the relevance vector; stocks outside the graph get zeros."""
    width = F.array_repeat(F.lit(0.0), 16)
    return df.join(relevance, "stock_code", "left").withColumn("relevance", F.coalesce("relevance", width))


def _first_codes(held: DataFrame, needed: DataFrame, top: int) -> DataFrame:
    """(a, s, w, code): the first ``top`` codes of each needed group (a, s, w, n) of stocks that share exactly s with a.

    The codes that hold s and weigh w there are read in order; those that share more with a do not count. The first
    few per (s, w), cut to so many per task before the shuffle, nearly always hold enough; groups that
    they leave short read all codes of their (s, w).
    """
    few = 4 * top
    index = held.select("stock_code", "held", _subsets("held").alias("m")).select(
        F.col("stock_code").alias("code"), _sectors(F.col("held")).alias("b"), _chosen("held", "m").alias("on")
    ).select("code", "b", _sectors(F.col("on")).alias("s"), _weight_on(F.col("on")).alias("w"))
    in_order = Window.partitionBy("s", "w").orderBy("code")
    begin = index.withColumn("_r", F.row_number().over(in_order)).filter(F.col("_r") <= few).drop("_r")
    exact = F.size(F.array_intersect("a", "b")) == F.size("s")
    found = needed.join(begin, ["s", "w"]).filter(exact).select("a", "s", "w", "code")
    got = found.groupBy("a", "s", "w").agg(F.count("*").alias("_got"))
    short = needed.join(got, ["a", "s", "w"], "left").filter(F.coalesce("_got", F.lit(0)) < F.least("n", F.lit(top))).select("a", "s", "w")
    rest = short.join(index, ["s", "w"]).filter(exact).select("a", "s", "w", "code")
    first = Window.partitionBy("a", "s", "w").orderBy("code")
    return found.union(rest).distinct().withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= top).drop("_r")


def related_stocks(edges: DataFrame, stock_dim: DataFrame, top_n: int = 10, min_corr: float = 0.3) -> DataFrame:
    """(stock_code, code, name, industry, corr, rank): the most correlated other stocks, ties by code.

    Per kind only the groups that can reach the first top_n + 1 places (one may be the stock itself) are opened.
    """
    held = holdings(edges)
    kinds = _kinds(held)
    groups = _groups(kinds, exact_meetings(held)).filter(F.col("corr") >= min_corr)
    down = Window.partitionBy("kind").orderBy(F.col("corr").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.sum("n").over(down) - F.sum("n").over(Window.partitionBy("kind", "corr"))
    opened = groups.withColumn("_ahead", ahead).filter(F.col("_ahead") <= top_n).select("kind", "a", "s", "w", "n", "corr")
    opened = materialize(opened, "groups")
    codes = _first_codes(held, opened.select("a", "s", "w", "n").distinct(), top_n + 1)
    by_kind = Window.partitionBy("kind").orderBy(F.col("corr").desc(), "code")
    best = (
        opened.select("kind", "a", "s", "w", "corr")
        .join(codes, ["a", "s", "w"])
        .withColumn("_rn", F.row_number().over(by_kind))
        .filter(F.col("_rn") <= top_n + 1)
        .select("kind", "code", "corr")
    )
    w = Window.partitionBy("stock_code").orderBy(F.col("corr").desc(), "code")
    return (
        held.join(kinds.select("held", "kind"), "held")
        .select("stock_code", "kind")
        .join(best, "kind")
        .filter("stock_code <> code")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= top_n)
        .select("stock_code", "code", "corr", "rank")
        .join(stock_dim.select(F.col("stock_code").alias("code"), "name", "industry"), "code", "left")
        .select(
            "stock_code",
            "code",
            F.coalesce("name", "code").alias("name"),
            F.coalesce("industry", F.lit("未知")).alias("industry"),
            "corr",
            "rank",
        )
    )


def concept_stocks(edges: DataFrame, stock_dim: DataFrame, concept: str) -> DataFrame:
    """Stocks of one concept, strongest first."""
    return (
        edges.filter(F.col("sector") == concept)
        .join(stock_dim.select("stock_code", "name", "industry"), "stock_code", "left")
        .select(
            "stock_code",
            F.coalesce("name", "stock_code").alias("name"),
            F.col("weight").alias("relevance"),
            F.coalesce("industry", F.lit("未知")).alias("industry"),
        )
        .orderBy(F.col("relevance").desc(), "stock_code")
    )


def sector_members(company: DataFrame, sector: str, limit: int | None = None) -> DataFrame:
    """Companies whose sector or industry is the given one."""
    hit = company.filter((F.col("sector") == sector) | (F.col("industry") == sector)).orderBy("stock_code")
    return hit if limit is None else hit.limit(limit)


def graph_neighborhood(edges: DataFrame, stock_dim: DataFrame, centers: DataFrame, depth: int = 2):
    """Nodes and edges around each center: its sectors and, at depth 2, their other stocks.

    A peer keeps only the edge of the first sector (by the center's order: weight, then name)
    that reaches it.
    """
    own = edges.join(centers.select("stock_code").distinct(), "stock_code", "left_semi").select(
        F.col("stock_code").alias("center"), "sector", "weight"
    )
    direct = own.select(
        "center", F.col("center").alias("source"), F.col("sector").alias("target"), round_half_up(F.col("weight"), 2).alias("weight")
    )
    dim = stock_dim.select(F.col("stock_code").alias("id"), F.col("name").alias("label"), "industry")
    center_nodes = centers.select(F.col("stock_code").alias("center"), F.col("stock_code").alias("id")).distinct()
    out_edges, stocks = direct, center_nodes
    if depth >= 2:
        peers = own.select("center", "sector", F.col("weight").alias("_cw")).join(
            edges.select(F.col("stock_code").alias("peer"), "sector", "weight"), "sector"
        ).filter("peer <> center")
        first = peers.groupBy("center", "peer").agg(
            F.min_by(F.struct("sector", "weight"), F.struct(-F.col("_cw"), F.col("sector"))).alias("e")
        )
        out_edges = direct.unionByName(
            first.select(
                "center",
                F.col("peer").alias("source"),
                F.col("e.sector").alias("target"),
                round_half_up(F.col("e.weight"), 2).alias("weight"),
            )
        )
        stocks = center_nodes.unionByName(first.select("center", F.col("peer").alias("id")))
    stock_nodes = stocks.join(dim, "id", "left").select(
        "center",
        "id",
        F.coalesce("label", "id").alias("label"),
        F.lit("stock").alias("type"),
        F.coalesce("industry", F.lit("未知")).alias("industry"),
    )
    sector_nodes = own.select(
        "center",
        F.concat(F.lit("sector_"), "sector").alias("id"),
        F.col("sector").alias("label"),
        F.lit("sector").alias("type"),
        F.lit(None).cast("string").alias("industry"),
    ).distinct()
    return stock_nodes.unionByName(sector_nodes), out_edges


def sector_heatmap(edges: DataFrame, sectors: DataFrame, top: int = 5) -> DataFrame:
    """Per listed sector: stock count, mean weight and strongest stocks."""
    w = Window.partitionBy("sector").orderBy(F.col("weight").desc(), "stock_code")
    best = (
        edges.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= top)
        .groupBy("sector")
        .agg(F.sort_array(F.collect_list(F.struct("_rn", "stock_code"))).alias("_b"))
        .select("sector", F.col("_b.stock_code").alias("top_stocks"))
    )
    stats = edges.groupBy("sector").agg(
        F.count("*").alias("stock_count"), round_half_up(F.avg("weight"), 3).alias("avg_relevance")
    )
    return (
        sectors.select("sector")
        .join(stats, "sector", "left")
        .join(best, "sector", "left")
        .fillna(0, subset=["stock_count", "avg_relevance"])
        .withColumn("top_stocks", F.coalesce("top_stocks", F.array().cast("array<string>")))
    )


def news_propagation(news_sectors: DataFrame, edges: DataFrame, stock_dim: DataFrame, id_col: str = "news_id", top: int = 10) -> DataFrame:
    """Direct and indirect stock impact of each item's sectors; top 10 of each kind.

    news_sectors: (id_col, sector, impact). Direct: sum of weight x impact. Indirect: half the
    correlation of the 5 closest relatives of each directly hit stock that are not hit directly.
    Items with the same sector set share one computation of both sides.
    """
    sets = news_sectors.groupBy(id_col).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("sector", "impact")))).alias("_set")
    )
    first = sets.groupBy("_set").agg(F.min(id_col).alias(id_col))
    distinct_sets = news_sectors.join(first, id_col).select("_set", "sector", "impact")
    direct = (
        distinct_sets.join(edges, "sector")
        .groupBy("_set", F.col("stock_code").alias("code"))
        .agg(F.sum(F.col("weight") * F.col("impact")).alias("_v"))
    )
    near = related_stocks(edges, stock_dim, 5, 0.3).select(
        F.col("stock_code").alias("_hit"), F.col("code").alias("_rel"), "corr"
    )
    indirect = (
        direct.select("_set", F.col("code").alias("_hit"))
        .join(near, "_hit")
        .select("_set", F.col("_rel").alias("code"), "corr")
        .join(direct.select("_set", "code"), ["_set", "code"], "left_anti")
        .groupBy("_set", "code")
        .agg(F.sum(F.col("corr") * 0.5).alias("_v"))
    )
    both = direct.withColumn("kind", F.lit("direct")).unionByName(indirect.withColumn("kind", F.lit("indirect")))
    w = Window.partitionBy("_set", "kind").orderBy(F.abs(F.col("impact")).desc(), "code")
    ranked = (
        both.select("_set", "kind", "code", round_half_up(F.col("_v"), 3).alias("impact"))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= top)
    )
    return sets.join(ranked, "_set").select(id_col, "kind", "code", "impact", "rank")
