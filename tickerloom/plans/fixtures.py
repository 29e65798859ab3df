"""The domain tables, derived from the supplied ones, as DataFrames and as SQL."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickerloom.functions.codes import news_id, pad_code
from tickerloom.functions.maths import round_half_up
from tickerloom.functions.text import normalize_text
from tickerloom.operators.calendar import align_news, calendar_of
from tickerloom.plans.registry import cte

AS_OF = "2001-02-01 00:00:00"
SECTORS = {f"S{i}": f"s{i}" for i in range(17)}
EVENTS = {"click": "click", "error": "error", '"k": 1': "k1", "purchase": "purchase"}
POSITIVE = {"for": 1.0, "with": 1.1, "this": 0.9}
NEGATIVE = {"that": 1.2, "was": 1.0, "are": 0.8}
NEGATION, INTENSIFY, UNCERTAIN = ["of"], ["in"], ["it"]
POSITIVE_PATTERNS, NEGATIVE_PATTERNS = ["the", "and"], ["to", "un"]
CATEGORY_TERMS = {"a": ["with", "les"], "b": ["der", "ing"], "c": ["que"]}
SECTOR_TERMS = {"north": ["the ", "ein"], "south": ["tion", "eau"], "west": ["zz"], "east": ["ar", "sh"]}
TITLE_TERMS = ["the", "le", "en"]
EVENT_FACTORS = [("click", 0.8, 5, ["S1", "S2"]), ("error", -0.6, 4, []), ('"k": 1', 0.3, 7, ["S3"]), ("signup", 0.5, 3, ["S9"])]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """documents; a file with fewer splits than cores is spread before the heavy text work."""
    d = table(spark, sf, "documents")
    cores = spark.sparkContext.defaultParallelism
    return d if d.rdd.getNumPartitions() >= cores else d.repartition(cores)


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def market(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per supplier; (stock_code, trade_date) is unique by construction."""
    k = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        table(spark, sf, "lineitem")
        .groupBy(pad_code(F.col("l_suppkey")).alias("stock_code"), F.to_date("l_shipdate").alias("trade_date"))
        .agg(
            F.min_by(p, k).alias("open"),
            F.max(p).alias("high"),
            F.min(p).alias("low"),
            F.max_by(p, k).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


cte(
    "fx_lines",
    """SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stock_code, CAST(l_shipdate AS DATE) AS trade_date,
    l_extendedprice / l_quantity AS p, l_quantity,
    {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice, 'e': l_quantity} AS k FROM lineitem""",
)
cte(
    "fx_market",
    """SELECT stock_code, trade_date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
    sum(l_quantity) AS volume FROM fx_lines GROUP BY ALL""",
)


def news(spark: SparkSession, sf: str) -> DataFrame:
    """Scored items from events, on January 2001."""
    n = table(spark, sf, "supplier").agg(F.count("*")).scalar()
    k = F.get_json_object("props", "$.k").cast("int")
    v = (F.col("value") - 50) / 50
    return table(spark, sf, "events").select(
        F.substring(F.md5(F.col("event_id").cast("string")), 1, 12).alias("news_id"),
        F.col("event_id").alias("arrival"),
        pad_code(F.col("user_id") % n).alias("stock_code"),
        (F.col("ts").cast("timestamp") - F.expr("INTERVAL 8400 DAYS")).alias("publish_time"),
        F.col("event_type").alias("source"),
        F.col("event_type").alias("title"),
        F.col("props").alias("content"),
        round_half_up(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)), 3).alias("sentiment"),
        F.least(F.lit(1.0), 0.5 + F.col("value") / 500).alias("importance"),
        F.create_map(
            F.concat(F.lit("S"), (k % 17).cast("string")), F.when(k % 2 == 0, 0.8).otherwise(0.5)
        ).alias("affected_sectors"),
        F.array(F.col("event_type"), F.when(k % 2 == 0, "even").otherwise("odd")).alias("categories"),
    )


def half_up(x: str, n: int) -> str:
    """SQL of round-half-away by floor."""
    return f"(sign({x}) * floor(abs({x}) * 1e{n} + 0.5) / 1e{n})"


cte(
    "fx_news",
    f"""SELECT news_id, arrival, stock_code, publish_time, source, title, content, {half_up('s', 3)} AS sentiment, importance,
    'S' || CAST(k % 17 AS VARCHAR) AS sector, CASE WHEN k % 2 = 0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS sw, k
    FROM (SELECT substr(md5(CAST(event_id AS VARCHAR)), 1, 12) AS news_id, event_id AS arrival,
      lpad(CAST(user_id % (SELECT count(*) FROM supplier) AS VARCHAR), 6, '0') AS stock_code,
      ts - INTERVAL 8400 DAY AS publish_time, event_type AS source, event_type AS title, props AS content,
      greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 50)) AS s, least(1.0::DOUBLE, 0.5::DOUBLE + value / 500) AS importance,
      CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INT) AS k FROM events)""",
)
cte("fx_cal", "SELECT DISTINCT stock_code, trade_date, trade_date + INTERVAL 15 HOUR AS close_ts FROM fx_lines")
cte(
    "fx_aligned",
    """SELECT n.*, c.trade_date, c.close_ts, greatest(epoch_us(c.close_ts) - epoch_us(n.publish_time), 0) / 3.6e9 AS hours,
    greatest(0.01::DOUBLE, least(1.0::DOUBLE, exp(-(greatest(epoch_us(c.close_ts) - epoch_us(n.publish_time), 0) / 3.6e9) * ln(2) / 24))) AS w
    FROM fx_news n ASOF JOIN fx_cal c ON n.stock_code = c.stock_code AND n.publish_time <= c.close_ts""",
)


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .select(pad_code(F.col("l_suppkey")).alias("stock_code"), F.to_date("l_shipdate").alias("trade_date"))
        .distinct()
    )


def aligned(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    return align_news(news(spark, sf), calendar(spark, sf) if days is None else days)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Three most traded brands of each supplier as its sectors."""
    w = Window.partitionBy("l_suppkey").orderBy(F.col("n").desc(), "p_brand")
    counts = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "p_brand")
        .agg(F.count("*").alias("n"))
    )
    r = F.col("r")
    return (
        counts.withColumn("r", F.row_number().over(w))
        .filter("r <= 3")
        .select(
            pad_code(F.col("l_suppkey")).alias("stock_code"),
            F.col("p_brand").alias("sector"),
            F.when(r == 1, 0.95).when(r == 2, 0.85).otherwise(0.75).alias("weight"),
        )
    )


cte(
    "fx_edges",
    """SELECT stock_code, sector, CASE r WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END AS weight FROM (
    SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stock_code, p_brand AS sector,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_brand) AS r
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand) WHERE r <= 3""",
)


def stock_dim(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(pad_code(F.col("s_suppkey")).alias("stock_code"), F.col("s_name").alias("name"), F.col("n_name").alias("industry"), "n_regionkey")
    )


def company(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    concepts = edges(spark, sf).groupBy("stock_code").agg(F.sort_array(F.collect_list("sector")).alias("concepts"))
    listed = (calendar(spark, sf) if days is None else days).groupBy("stock_code").agg(F.min("trade_date").alias("listing_date"))
    return (
        stock_dim(spark, sf)
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("stock_code", "name", "industry", F.col("r_name").alias("sector"))
        .join(concepts, "stock_code", "left")
        .join(listed, "stock_code", "left")
    )


cte(
    "fx_stock",
    """SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code, s_name AS name, n_name AS industry, r_name AS sector
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "fx_company",
    """SELECT s.*, c.concepts, l.listing_date FROM fx_stock s
    LEFT JOIN (SELECT stock_code, list_sort(list(sector)) AS concepts FROM fx_edges GROUP BY 1) c USING (stock_code)
    LEFT JOIN (SELECT stock_code, min(trade_date) AS listing_date FROM fx_cal GROUP BY 1) l USING (stock_code)""",
)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Text items from documents; times and URLs repeat so that copies meet."""
    d = texts(spark, sf)
    ts = F.lit("2001-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") * 37 % 4320).cast("int"))
    return d.select(
        F.col("doc_id").alias("arrival"),
        F.trim(F.substring("text", 1, 40)).alias("title"),
        F.trim("text").alias("content"),
        ts.alias("publish_time"),
        F.concat(F.lit("https://Example.com/d/"), F.col("n_chars").cast("string"), F.lit("?q="), F.col("doc_id").cast("string")).alias("url"),
        F.col("source"),
        "lang",
    ).withColumn("news_id", news_id(F.col("title"), F.col("publish_time"), F.concat(F.lit("https://example.com/d/"), F.col("arrival").cast("string"))))


cte(
    "fx_docs0",
    """SELECT doc_id AS arrival, trim(substr("text", 1, 40)) AS title, trim("text") AS content,
    TIMESTAMP '2001-01-01' + to_minutes(CAST(doc_id * 37 % 4320 AS INT)) AS publish_time,
    'https://Example.com/d/' || CAST(n_chars AS VARCHAR) || '?q=' || CAST(doc_id AS VARCHAR) AS url, source, lang, n_chars FROM documents""",
)
cte(
    "fx_docs",
    """SELECT *, substr(md5(title || '|' || strftime(publish_time, '%Y-%m-%d %H:%M:%S') || '|https://example.com/d/' || CAST(arrival AS VARCHAR)), 1, 12) AS news_id
    FROM fx_docs0""",
)
cte("fx_norm", "SELECT arrival, news_id, regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', '', 'g') AS t, regexp_replace(lower(title || ' ' || content), '[^\\p{L}\\p{N}_]+', '', 'g') AS m FROM fx_docs")


def alias_dim(spark: SparkSession, sf: str) -> DataFrame:
    """(code, alias): the code and two marker strings from the document of the same number."""
    word = normalize_text(F.col("text"))
    numbers = table(spark, sf, "supplier").select("s_suppkey")
    own = table(spark, sf, "documents").join(numbers, F.col("s_suppkey") == F.col("doc_id"), "left_semi").select("doc_id", "text")
    marked = (
        numbers.join(own, F.col("s_suppkey") == F.col("doc_id"), "left")
        .select(pad_code(F.col("s_suppkey")).alias("code"), word.alias("w"))
    )
    forms = F.array("code", F.substring("w", 1, 6), F.substring("w", 1, 9))
    return marked.select("code", F.explode(forms).alias("alias")).filter("length(alias) >= 2").distinct()


cte(
    "fx_alias",
    """SELECT DISTINCT code, alias FROM (SELECT code, unnest([code, substr(w, 1, 6), substr(w, 1, 9)]) AS alias FROM (
      SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, regexp_replace(lower("text"), '[^\\p{L}\\p{N}_]+', '', 'g') AS w
      FROM supplier LEFT JOIN documents ON s_suppkey = doc_id)) WHERE length(alias) >= 2""",
)


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """(sector, stock_code, weight) from the accounts of suppliers, with a default for even sectors."""
    s = table(spark, sf, "supplier")
    own = s.select(
        F.concat(F.lit("S"), (F.col("s_suppkey") % 17).cast("string")).alias("sector"),
        pad_code(F.col("s_suppkey")).alias("stock_code"),
        (0.5 + (F.col("s_suppkey") % 10) / 20).alias("weight"),
    )
    base = s.select((F.col("s_suppkey") % 17).alias("k")).distinct().filter("k % 2 = 0").select(
        F.concat(F.lit("S"), F.col("k").cast("string")).alias("sector"), F.lit("default").alias("stock_code"), (0.1 + F.col("k") / 50).alias("weight")
    )
    return own.unionByName(base)


cte(
    "fx_weights",
    """SELECT 'S' || CAST(s_suppkey % 17 AS VARCHAR) AS sector, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code,
    0.5::DOUBLE + (s_suppkey % 10) / 20.0::DOUBLE AS weight FROM supplier
    UNION ALL SELECT 'S' || CAST(k AS VARCHAR), 'default', 0.1::DOUBLE + k / 50.0::DOUBLE FROM (SELECT DISTINCT s_suppkey % 17 AS k FROM supplier) WHERE k % 2 = 0""",
)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(label, score, src) from labels and documents, with many ties."""
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        "doc_id",
        F.col("quality").alias("label"),
        ((F.col("n_chars") % 100) / 100).alias("score"),
        F.col("lang").alias("grp"),
        F.to_date(F.lit("2001-01-01")).alias("_d0"),
        (F.col("n_chars") / 1000.0 - 2).alias("ret"),
    ).withColumn("trade_date", F.date_add("_d0", (F.col("doc_id") % 5).cast("int"))).drop("_d0")


cte(
    "fx_scores",
    """SELECT doc_id, quality AS label, (n_chars % 100) / 100.0::DOUBLE AS score, lang AS grp, n_chars / 1000.0::DOUBLE - 2 AS ret,
    DATE '2001-01-01' + CAST(doc_id % 5 AS INT) AS trade_date FROM labels JOIN documents USING (doc_id)""",
)
