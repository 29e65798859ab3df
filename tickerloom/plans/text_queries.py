"""Queries on text: scoring, matching, de-duplication, feeds, encoders."""

from pyspark.sql import functions as F

from tickerloom.functions import codes, text as tx
from tickerloom.operators import dedupe, encode, matching, news as nw
from tickerloom.plans import fixtures as fx
from tickerloom.plans.registry import CTES, cte, query
from tickerloom.sources import feeds

LEXICON = dict(
    positive=fx.POSITIVE, negative=fx.NEGATIVE, negation=fx.NEGATION, intensify=fx.INTENSIFY,
    positive_patterns=fx.POSITIVE_PATTERNS, negative_patterns=fx.NEGATIVE_PATTERNS, uncertain=fx.UNCERTAIN,
)
cte("tx", "SELECT *, trim(title || ' ' || content) AS body, trim(title || ' ' || trim(title || ' ' || content)) AS m FROM fx_docs")


def cnt(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, '{term}', ''))) / {len(term)})"


def _word_sql(word: str, weight: float) -> str:
    """Split the text at the word; the context of a hit is the tail of the pieces before it."""
    ctx = f"right(list_aggregate(list_slice(ps, greatest(i - 3, 1), i), 'string_agg', '{word}'), 8)"
    neg = " OR ".join(f"contains({ctx}, '{w}')" for w in fx.NEGATION)
    inten = " OR ".join(f"contains({ctx}, '{w}')" for w in fx.INTENSIFY)
    return f"""(SELECT coalesce(sum({weight} * CASE WHEN {neg} THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN {inten} THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END), 0)
      FROM (SELECT string_split(m, '{word}') AS ps) z, range(1, len(ps)) t(i)) * CASE WHEN contains(title, '{word}') THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END"""


KW = " + ".join(_word_sql(w, v) for w, v in fx.POSITIVE.items()) + " - " + " - ".join(_word_sql(w, v) for w, v in fx.NEGATIVE.items())
hits = lambda ps: " + ".join(f"({cnt('m', p)} + CASE WHEN contains(m, '{p}') AND contains(title, '{p}') THEN 1 ELSE 0 END)" for p in ps)
cte(
    "tx_score",
    f"""SELECT *, tanh(({KW}) / 4) AS kw, CASE WHEN p + g > 0 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (p - g) / (p + g) * greatest(0.5::DOUBLE, 1 - 0.08 * u))) ELSE 0.0::DOUBLE END AS sem
    FROM (SELECT *, CAST({hits(fx.POSITIVE_PATTERNS)} AS DOUBLE) AS p, CAST({hits(fx.NEGATIVE_PATTERNS)} AS DOUBLE) AS g, {' + '.join(cnt('m', w) for w in fx.UNCERTAIN)} AS u FROM tx)""",
)
cte("tx_sent", f"SELECT *, {fx.half_up('greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 0.6 * kw + 0.4 * sem))', 3)} AS sentiment FROM tx_score")
cte(
    "tx_imp",
    "SELECT *, least(1.0::DOUBLE, "
    + fx.half_up(
        "(0.5::DOUBLE + " + " + ".join(f"CASE WHEN contains(title, '{w}') THEN 0.1::DOUBLE ELSE 0 END" for w in fx.TITLE_TERMS)
        + " + CASE WHEN length(content) > 200 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(content, '\\d+[.%亿万元]') THEN 0.05::DOUBLE ELSE 0 END)", 2)
    + ") AS importance FROM tx_sent",
)


def _contains_any(col, terms):
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in terms) + ")"


CATS = "list_filter([" + ", ".join(f"CASE WHEN {_contains_any('body', ts)} THEN '{c}' END" for c, ts in fx.CATEGORY_TERMS.items()) + "], lambda x: x IS NOT NULL)"


def _sector_sql(terms):
    return "CASE " + " ".join(f"WHEN contains(body, '{t}') THEN CASE WHEN contains(substr(body, 1, 100), '{t}') THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END" for t in terms) + " END"


def texts(spark, sf):
    return fx.docs(spark, sf).withColumn("body", tx.merged_text(F.col("title"), F.col("content")))


@query(
    "b34_b37_sentiment",
    "SELECT arrival, kw AS keyword, sem AS semantic, sentiment AS hybrid FROM tx_sent",
    d="keyword semantic hybrid", i="arrival",
)
def sentiment(spark, sf):
    """Keyword (with B35 context), phrase and hybrid sentiment of whole documents."""
    d = texts(spark, sf).withColumn("m", F.trim(F.concat("title", F.lit(" "), "body")))
    kw = tx.keyword_sentiment(F.col("m"), F.col("title"), fx.POSITIVE, fx.NEGATIVE, fx.NEGATION, fx.INTENSIFY)
    sem = tx.semantic_sentiment(F.col("m"), F.col("title"), fx.POSITIVE_PATTERNS, fx.NEGATIVE_PATTERNS, fx.UNCERTAIN)
    return d.select("arrival", kw.alias("keyword"), sem.alias("semantic"), tx.hybrid_sentiment(F.col("body"), F.col("title"), **LEXICON).alias("hybrid"))


@query("b35_context_modifier", "SELECT arrival, CASE WHEN contains(c, 'of') THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN contains(c, 'in') THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS modifier FROM (SELECT arrival, content AS c FROM fx_docs)", d="modifier", i="arrival")
def b35(spark, sf):
    """Whether a document holds a negation or an intensifier anywhere; single hits: b35_context_modifier_hits."""
    return fx.docs(spark, sf).select("arrival", tx.context_modifier(F.col("content"), fx.NEGATION, fx.INTENSIFY).alias("modifier"))


KEYWORDS = [*fx.POSITIVE, *fx.NEGATIVE]


def _hits_sql(word: str) -> str:
    """(arrival, word, hits, modifier): the text is split at the word, the context of a hit is the tail before it."""
    ctx = f"right(list_aggregate(list_slice(ps, greatest(i - 7, 1), i), 'string_agg', '{word}'), 8)"
    neg, inten = _contains_any("c", fx.NEGATION), _contains_any("c", fx.INTENSIFY)
    return f"""SELECT arrival, '{word}' AS word, count(*) AS hits, sum(CASE WHEN {neg} THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN {inten} THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) AS modifier
    FROM (SELECT arrival, {ctx} AS c FROM (SELECT arrival, ps, unnest(range(1, len(ps))) AS i FROM (SELECT arrival, string_split(content, '{word}') AS ps FROM fx_docs))) GROUP BY 1"""


@query("b35_context_modifier_hits", " UNION ALL ".join(map(_hits_sql, KEYWORDS)), d="modifier", i="arrival hits")
def b35_hits(spark, sf):
    """Every hit of every keyword in the whole content, judged by what stands before it."""
    c = F.col("content")
    each = [F.struct(F.lit(w).alias("word"), tx.count_of(c, w).alias("hits"), tx.hit_strength(c, w, fx.NEGATION, fx.INTENSIFY).alias("modifier")) for w in KEYWORDS]
    return fx.docs(spark, sf).select("arrival", F.explode(F.array(*each)).alias("h")).select("arrival", "h.*").filter("hits > 0")


@query(
    "b33_b39_text_rules",
    f"""SELECT arrival, array_to_string(CASE WHEN len({CATS}) > 0 THEN {CATS} ELSE ['other'] END, ',') AS categories, importance,
    {', '.join(f"{_sector_sql(ts)} AS {s}" for s, ts in fx.SECTOR_TERMS.items())}, {_contains_any('body', ['qz', 'zw'])} AS rare,
    length(content) + importance * 120 + 15.0::DOUBLE AS quality FROM tx_imp""",
    d="importance north south west east quality", i="arrival",
)
def text_rules(spark, sf):
    """B33 categories, B38 importance, B39 sectors, B11 contains, B41 quality."""
    d = texts(spark, sf)
    imp = tx.importance(F.col("title"), F.col("content"), fx.TITLE_TERMS)
    sectors = tx.affected_sectors(F.col("body"), fx.SECTOR_TERMS)
    d = d.withColumns({"importance": imp, "s": sectors})
    return d.select(
        "arrival",
        F.array_join(tx.classify_categories(F.col("body"), fx.CATEGORY_TERMS, "other"), ",").alias("categories"),
        "importance",
        *[F.try_element_at("s", F.lit(k)).alias(k) for k in fx.SECTOR_TERMS],
        tx.contains_any(F.col("body"), ["qz", "zw"]).alias("rare"),
        tx.news_quality_score(F.col("content"), F.col("importance"), F.col("url")).alias("quality"),
    )


@query(
    "b_urls",
    """SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS norm,
    substr(md5('t|2001-01-01 00:00:00|' || url), 1, 12) AS news_id, contains(url, '.example.com/') AS article, regexp_matches(url, '(?i)\\.shtml($|\\?)') AS article_own,
    trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\\s\\x{3000}\\x{a0}]+', ' ', 'g')) AS plain,
    regexp_replace(lower(html), '[^\\p{L}\\p{N}_]+', '', 'g') AS letters FROM pages""",
    i="page_id",
)
def b_urls(spark, sf):
    """B5-B8 and B14 on crawled pages."""
    p = fx.table(spark, sf, "pages")
    ts = F.lit("2001-01-01").cast("timestamp")
    shtml = F.concat(F.regexp_extract("url", r"^(https?://[^?#]+)", 1), F.lit(".shtml"))  # the page's own path, as an article
    return p.select(
        "page_id",
        codes.normalize_url(F.col("url")).alias("norm"),
        codes.news_id(F.lit("t"), ts, F.col("url")).alias("news_id"),
        codes.article_url_like(shtml, F.lit(".example.com")).alias("article"),
        codes.article_url_like(F.col("url")).alias("article_own"),
        tx.strip_html(F.col("html")).alias("plain"),
        tx.normalize_text(F.col("html")).alias("letters"),
    )


@query(
    "a11_parse_news_rows",
    f"""SELECT news_id, title, length(content) AS n, strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS publish_time, source, url, sentiment, importance, cats AS categories, sectors FROM (
    SELECT substr(md5(title || '|' || strftime(publish_time, '%Y-%m-%d %H:%M:%S') || '|' || url), 1, 12) AS news_id, * EXCLUDE (news_id),
    array_to_string(CASE WHEN len({CATS}) > 0 THEN {CATS} ELSE ['其他'] END, ',') AS cats,
    {' + '.join(f"CASE WHEN {_contains_any('body', ts)} THEN 1 ELSE 0 END" for ts in fx.SECTOR_TERMS.values())} AS sectors
    FROM (SELECT * REPLACE ('https://example.com/d/' || CAST(n_chars AS VARCHAR) AS url) FROM tx_imp))""",
    d="sentiment importance", i="n sectors",
)
def a11(spark, sf):
    raw = fx.docs(spark, sf).select("title", "content", F.date_format("publish_time", "yyyy/MM/dd HH:mm:ss").alias("publish_time"), "url", "source")
    bad = raw.withColumn("publish_time", F.lit("soon")).unionByName(raw.withColumn("title", F.lit(" ")))
    p = nw.parse_news_rows(
        raw.unionByName(bad), category_terms=fx.CATEGORY_TERMS, sector_terms=fx.SECTOR_TERMS, title_terms=fx.TITLE_TERMS, content_chars=None, **LEXICON
    )
    return p.select(
        "news_id", "title", F.length("content").alias("n"), "publish_time", "source", "url", "sentiment", "importance",
        F.array_join("categories", ",").alias("categories"), F.size("affected_sectors").alias("sectors"),
    )


# ---- matching

cte(
    "mt",
    """SELECT code AS stock_code, news_id, arg_max(CASE WHEN t_hit THEN CASE WHEN is_code THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END ELSE 0.8::DOUBLE END, {'c': is_code, 'l': n, 't': t_hit}) AS relevance FROM (
    SELECT code, news_id, alias = code AS is_code, length(alias) AS n, contains(t, alias) AS t_hit FROM fx_alias JOIN fx_norm ON contains(m, alias)) GROUP BY 1, 2""",
)


@query("c4_match_news_to_stocks", "SELECT * FROM mt", d="relevance")
def c4(spark, sf):
    m = matching.match_news_to_stocks(fx.docs(spark, sf), fx.alias_dim(spark, sf))
    return m.select("stock_code", "news_id", "relevance")


@query(
    "b10_build_alias_dim",
    """SELECT DISTINCT code, alias FROM (SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code, unnest([p_name, replace(p_name, ' ', ''), trim(regexp_replace(p_name, '(.)widget$', '\\1')),
    trim(regexp_replace(replace(p_name, ' ', ''), '(.)widget$', '\\1')), lpad(CAST(p_partkey AS VARCHAR), 6, '0')]) AS alias FROM part) WHERE length(alias) >= 2""",
)
def b10(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"))
    return matching.build_alias_dim(p, suffixes=["widget"])


@query(
    "a9_news_with_fallback",
    """SELECT stock_code, news_id FROM fx_news WHERE CAST(stock_code AS INT) % 2 = 0
    UNION ALL SELECT stock_code, news_id FROM (SELECT mt.stock_code, mt.news_id, row_number() OVER (PARTITION BY mt.stock_code ORDER BY publish_time DESC, mt.news_id) AS r FROM mt JOIN fx_docs USING (news_id)
    WHERE mt.stock_code NOT IN (SELECT stock_code FROM fx_news WHERE CAST(stock_code AS INT) % 2 = 0))""",
)
def a9(spark, sf):
    """Even stocks have news of their own; the others fall back to matched documents."""
    own = fx.news(spark, sf).filter(F.col("stock_code").cast("int") % 2 == 0).select("stock_code", "news_id")
    return nw.news_with_fallback(own, fx.docs(spark, sf), fx.alias_dim(spark, sf)).select("stock_code", "news_id")


# ---- de-duplication

cte(
    "dd_items",
    """SELECT arrival, nid, publish_time, content, imp, title, regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', '', 'g') AS t, lower(regexp_extract(url, '^([^?#]*)', 1)) AS u, url,
    length(content) + imp * 120 + 15.0::DOUBLE AS q FROM (SELECT *, news_id AS nid, (arrival % 7) / 10.0::DOUBLE AS imp FROM fx_docs)""",
)
cte(
    "dd_keys",
    """SELECT arrival, 1 AS prio, 'id::' || nid AS key FROM dd_items UNION ALL
    SELECT arrival, 2, 'b::' || t || strftime(time_bucket(INTERVAL 30 MINUTE, publish_time), '%Y%m%d%H%M') FROM dd_items WHERE t <> '' UNION ALL
    SELECT arrival, 3, 'd::' || t || strftime(publish_time, '%Y%m%d') FROM dd_items WHERE t <> '' UNION ALL
    SELECT arrival, 4, 'u::' || u FROM dd_items WHERE t <> ''""",
)
cte("dd_prev", "SELECT *, lag(arrival) OVER (PARTITION BY key ORDER BY arrival) AS prev FROM dd_keys")
cte("dd_parent", "SELECT arrival, coalesce(arg_min(prev, prio) FILTER (WHERE prev IS NOT NULL), arrival) AS parent FROM dd_prev GROUP BY 1")
SLOTS = """(WITH RECURSIVE up AS (SELECT arrival, parent FROM dd_parent UNION SELECT up.arrival, p.parent FROM up JOIN dd_parent p ON p.arrival = up.parent)
    SELECT arrival, min(parent) AS slot FROM up GROUP BY 1)"""
cte("dd_slot", f"SELECT * FROM {SLOTS}")
cte("dd_kept", "SELECT slot, arg_max(arrival, {'q': q, 'a': -arrival}) AS arrival FROM dd_slot JOIN dd_items USING (arrival) GROUP BY 1")


def items(spark, sf):
    return fx.docs(spark, sf).withColumn("importance", (F.col("arrival") % 7) / 10.0)


@query("g5_multi_key_dedupe", "SELECT arrival, nid AS news_id, title FROM dd_kept JOIN dd_items USING (arrival)", i="arrival")
def g5(spark, sf):
    return dedupe.multi_key_dedupe(items(spark, sf)).select("arrival", "news_id", "title")


@query("g5_news_slots", "SELECT arrival AS arr, slot FROM dd_slot", i="arr slot")
def g5b(spark, sf):
    return dedupe.news_slots(items(spark, sf))


cte("g4_rows", "SELECT arrival, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t, CAST(arrival % 3 AS VARCHAR) AS p, CAST(n_chars % 50 AS VARCHAR) AS u FROM fx_docs")


@query("g4_exact_record_dedupe", "SELECT min(arrival) AS arrival FROM g4_rows WHERE t <> '' GROUP BY t, p, u", i="arrival")
def g4(spark, sf):
    d = fx.docs(spark, sf)
    raw = d.select("arrival", "title", (F.col("arrival") % 3).cast("string").alias("publish_time"), (F.regexp_extract("url", r"/(\d+)\?", 1).cast("int") % 50).cast("string").alias("url"))
    return dedupe.exact_record_dedupe(raw)[0].select("arrival")


@query("g4_removed", "SELECT count(*) AS raw, (SELECT count(*) FROM (SELECT DISTINCT t, p, u FROM g4_rows WHERE t <> '')) AS kept, count(*) - (SELECT count(*) FROM (SELECT DISTINCT t, p, u FROM g4_rows WHERE t <> '')) AS removed FROM g4_rows", i="raw kept removed")
def g4b(spark, sf):
    d = fx.docs(spark, sf)
    raw = d.select("arrival", "title", (F.col("arrival") % 3).cast("string").alias("publish_time"), (F.regexp_extract("url", r"/(\d+)\?", 1).cast("int") % 50).cast("string").alias("url"))
    return dedupe.exact_record_dedupe(raw)[1]


@query("a17_sync_merge", "SELECT count(*) AS raw_total, (SELECT count(*) FROM dd_kept) AS unique_total, count(*) - (SELECT count(*) FROM dd_kept) AS removed FROM fx_docs", i="raw_total unique_total removed")
def a17(spark, sf):
    return nw.sync_merge(items(spark, sf))[2]


@query(
    "a21_news_query",
    "SELECT arrival, nid AS news_id, strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS publish_time FROM dd_kept JOIN dd_items USING (arrival) WHERE publish_time >= TIMESTAMP '2001-01-04' - INTERVAL 30 HOUR ORDER BY publish_time DESC, nid LIMIT 50",
    i="arrival",
)
def a21(spark, sf):
    as_of = F.lit("2001-01-04").cast("timestamp")
    page, _ = nw.news_query(items(spark, sf), fx.alias_dim(spark, sf), None, "all", 50, as_of, 30)
    return page.select("arrival", "news_id", "publish_time")


@query(
    "a21_news_query_counters",
    """SELECT 0 AS bad_timestamp_count, 0 AS stock_filtered_out_count, (SELECT count(*) FROM fx_docs) - (SELECT count(*) FROM dd_kept) AS dedup_removed_count,
    (SELECT count(*) FROM dd_kept JOIN dd_items USING (arrival) WHERE publish_time < TIMESTAMP '2001-01-04' - INTERVAL 30 HOUR) AS age_filtered_count""",
    i="bad_timestamp_count stock_filtered_out_count dedup_removed_count age_filtered_count",
)
def a21b(spark, sf):
    as_of = F.lit("2001-01-04").cast("timestamp")
    return nw.news_query(items(spark, sf), fx.alias_dim(spark, sf), None, "all", 50, as_of, 30)[1]


# the same for one stock and one source
cte("ds_docs", "SELECT * FROM fx_docs WHERE source = 'src1' AND news_id IN (SELECT news_id FROM mt WHERE stock_code = '000007')")
for _name in ("items", "keys", "prev", "parent", "slot", "kept"):
    cte(f"ds_{_name}", CTES[f"dd_{_name}"].replace("dd_", "ds_").replace("FROM fx_docs", "FROM ds_docs"))


def one_stock(spark, sf):
    return nw.news_query(items(spark, sf), fx.alias_dim(spark, sf), "000007", "src1", 50, F.lit("2001-01-04").cast("timestamp"), 60)


@query(
    "a21_news_query_stock",
    "SELECT arrival, nid AS news_id, strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS publish_time FROM ds_kept JOIN ds_items USING (arrival) WHERE publish_time >= TIMESTAMP '2001-01-04' - INTERVAL 60 HOUR ORDER BY publish_time DESC, nid LIMIT 50",
    i="arrival",
)
def a21c(spark, sf):
    return one_stock(spark, sf)[0].select("arrival", "news_id", "publish_time")


@query(
    "a21_news_query_stock_counters",
    """SELECT 0 AS bad_timestamp_count, (SELECT count(*) FROM fx_docs WHERE source = 'src1') - (SELECT count(*) FROM ds_docs) AS stock_filtered_out_count,
    (SELECT count(*) FROM ds_docs) - (SELECT count(*) FROM ds_kept) AS dedup_removed_count,
    (SELECT count(*) FROM ds_kept JOIN ds_items USING (arrival) WHERE publish_time < TIMESTAMP '2001-01-04' - INTERVAL 60 HOUR) AS age_filtered_count""",
    i="bad_timestamp_count stock_filtered_out_count dedup_removed_count age_filtered_count",
)
def a21d(spark, sf):
    return one_stock(spark, sf)[1]


@query("a17_sync_sources", "SELECT source, count(*) AS fetched FROM fx_docs GROUP BY 1", i="fetched")
def a17b(spark, sf):
    return nw.sync_merge(items(spark, sf))[1]


# ---- encoders on text

cte("en_docs", "SELECT *, lpad(CAST(arrival % (SELECT count(*) FROM supplier) AS VARCHAR), 6, '0') AS stock_code, trim(title || ' ' || content) AS body FROM fx_docs")
GRAMS = " UNION ALL ".join(
    f"SELECT stock_code, unnest(regexp_extract_all(substr(body, {o + 1}), '(?s).{{{n}}}')) AS g FROM en_docs" for n in (2, 3, 4) for o in range(n)
)
cte("en_grams", GRAMS)
cte("en_hash", "SELECT stock_code, CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % 112 AS pos, count(*) AS n FROM en_grams GROUP BY 1, 2")


def stock_docs(spark, sf):
    n = fx.table(spark, sf, "supplier").agg(F.count("*")).scalar()
    d = fx.docs(spark, sf).withColumn("stock_code", codes.pad_code(F.col("arrival") % n))
    return d.withColumn("sentiment", (F.col("arrival") % 11 - 5) / 10.0)


@query(
    "d28_encode_text_hash",
    """SELECT c.stock_code, p.pos, coalesce(h.n, 0) / sqrt(sum(CAST(coalesce(h.n, 0) AS DOUBLE) * coalesce(h.n, 0)) OVER (PARTITION BY c.stock_code)) AS value
    FROM (SELECT DISTINCT stock_code FROM en_grams) c CROSS JOIN (SELECT unnest(range(112)) AS pos) p LEFT JOIN en_hash h ON h.stock_code = c.stock_code AND h.pos = p.pos""",
    d="value", i="pos",
)
def d28(spark, sf):
    return encode.encode_text_hash(stock_docs(spark, sf)).select("stock_code", F.posexplode("text_hash").alias("pos", "value"))


POS_W, NEG_W = ["the", "and"], ["un", "der"]
csum = lambda ws: " + ".join(cnt("body", w) for w in ws)
cte(
    "en_stats",
    f"""SELECT stock_code, [least(avg(length(title)) / 40, 1.0::DOUBLE), least(avg(length(content)) / 300, 1.0::DOUBLE),
    sum({csum(POS_W)}) / greatest(sum({csum(POS_W + NEG_W)}), 1), sum({csum(NEG_W)}) / greatest(sum({csum(POS_W + NEG_W)}), 1),
    least(sum({csum(['!', '！', '?', '？'])}) / greatest(count(*) FILTER (WHERE body <> ''), 1) / 8, 1.0::DOUBLE), least(max(u) / 800, 1.0::DOUBLE),
    least(count(*) FILTER (WHERE body <> '') / 20, 1.0::DOUBLE), avg((arrival % 11 - 5) / 10.0::DOUBLE)] AS v
    FROM en_docs JOIN (SELECT stock_code, count(DISTINCT c) AS u FROM (SELECT stock_code, unnest(string_split(body, '')) AS c FROM en_docs) GROUP BY 1) USING (stock_code) GROUP BY 1""",
)


@query("d27_encode_text_stats", "SELECT stock_code, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS value FROM en_stats", d="value", i="pos")
def d27(spark, sf):
    v = encode.encode_text_stats(stock_docs(spark, sf), POS_W, NEG_W, 8)
    return v.select("stock_code", F.posexplode("text_stats").alias("pos", "value"))


# ---- feeds


@query("a12_normalize_json_feed", "SELECT title, content, CAST(arrival AS VARCHAR) AS publish_time, source, url FROM (SELECT arrival, trim(title) AS title, trim(content) AS content, source, url FROM fx_docs) WHERE title <> ''")
def a12(spark, sf):
    """Documents packed twenty to a payload and read back through a list path and a field map."""
    d = fx.docs(spark, sf)
    item = F.struct(
        F.struct(F.col("title").alias("main")).alias("head"), F.col("content").alias("body"), F.col("arrival").alias("when"), F.col("source").alias("mediaName"), F.col("url").alias("link")
    )
    packed = d.groupBy(F.floor(F.col("arrival") / 20).alias("batch")).agg(
        F.to_json(F.struct(F.struct(F.collect_list(item).alias("list")).alias("data"))).alias("payload")
    )
    rules = {"title": "head.main", "content": ["summary", "body"], "publish_time": {"path": "when"}, "url": {"paths": ["href", "link"]}}
    return feeds.normalize_json_feed(packed, "data.list", rules).drop("batch")


@query("a13_unwrap_jsonp", "SELECT event_id, props AS body FROM events", i="event_id")
def a13(spark, sf):
    e = fx.table(spark, sf, "events")
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("cb_1("), "props", F.lit(");"))).otherwise(F.col("props"))
    return e.select("event_id", feeds.unwrap_jsonp(wrapped).alias("body"))


@query(
    "a14_normalize_feed_xml",
    "SELECT 't' || CAST(event_id AS VARCHAR) AS title, event_type AS content, strftime(ts, '%Y-%m-%d') AS publish_time, 'u' || CAST(user_id AS VARCHAR) AS source, 'https://e.com/' || CAST(event_id AS VARCHAR) AS url FROM events",
)
def a14(spark, sf):
    """Events as RSS items (even batches) and Atom entries (odd ones)."""
    e = fx.table(spark, sf, "events")
    day, eid = F.date_format("ts", "yyyy-MM-dd"), F.col("event_id").cast("string")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    link = F.concat(F.lit("https://e.com/"), eid)
    who = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    rss = tag("item", F.concat(tag("title", F.concat(F.lit("t"), eid)), tag("description", F.col("event_type")), tag("pubDate", day), tag("source", who), tag("link", link)))
    atom = tag("entry", F.concat(tag("title", F.concat(F.lit("t"), eid)), tag("summary", F.col("event_type")), tag("updated", day), tag("author", who), F.lit('<link href="'), link, F.lit('"/>')))
    batch = F.floor(F.col("event_id") / 25)
    per = e.select(batch.alias("b"), rss.alias("r"), atom.alias("a")).groupBy("b").agg(F.array_join(F.collect_list("r"), "").alias("r"), F.array_join(F.collect_list("a"), "").alias("a"))
    xml = F.when(F.col("b") % 2 == 0, F.concat(F.lit("<rss><channel><title>c</title>"), "r", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit("<feed>"), "a", F.lit("</feed>")))
    return feeds.normalize_feed_xml(per.select(xml.alias("xml")))


@query(
    "a14_feed_details",
    """SELECT 't' || CAST(event_id AS VARCHAR) AS title, event_type AS content, strftime(ts, '%Y-%m-%d') AS publish_time, 'wire' AS source,
    CASE event_id % 4 WHEN 0 THEN 'https://e.com/' WHEN 1 THEN 'https://e.com/n/' WHEN 2 THEN 'https://other.org/' ELSE 'https://e.com/feeds/rss.xml?id=' END || CAST(event_id AS VARCHAR) AS url FROM events""",
)
def a14_details(spark, sf):
    """Events as items of a tag of their own with namespaced fields and links relative to the feed."""
    e = fx.table(spark, sf, "events")
    eid, k = F.col("event_id").cast("string"), F.col("event_id") % 4
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    link = F.concat(F.when(k == 0, "../").when(k == 1, "/x/../n/./").when(k == 2, "//other.org/").otherwise("?id="), eid)
    item = tag("news", F.concat(tag("title", F.concat(F.lit("t"), eid)), tag("content:encoded", F.col("event_type")), tag("dc:date", F.date_format("ts", "yyyy-MM-dd")), tag("link", link)))
    per = e.select(F.floor(F.col("event_id") / 25).alias("b"), item.alias("x")).groupBy("b").agg(F.array_join(F.collect_list("x"), "").alias("x"))
    spaces = '<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title>'
    feed = per.select(F.concat(F.lit(spaces), "x", F.lit("</channel></rss>")).alias("xml"))
    return feeds.normalize_feed_xml(feed, source_name="wire", item_tag="news", feed_url="https://e.com/feeds/rss.xml?page=1")


@query(
    "a15_extract_listing_html",
    """SELECT page_id, unnest(list_filter(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1), lambda x: true)) AS href FROM pages""",
    i="page_id",
)
def a15(spark, sf):
    rows = feeds.extract_listing_html(fx.table(spark, sf, "pages"), "nav li", {"content": None, "publish_time": {"value": "2001-01-01"}, "href": {"selector": "a", "attr": "href"}})
    return rows.select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1).alias("href"))


@query(
    "a16_score_listing_selectors",
    """SELECT page_id, 'li' AS selector, u + 0.02 * least(h, 100) AS score, u AS unique_hit, h AS hit, 0 AS date_hit, 'a' AS title_selector, 'span.list_time' AS date_selector FROM (
    SELECT page_id, count(*) AS h, count(DISTINCT href) AS u FROM (SELECT page_id, regexp_extract(li, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(li, '<[^>]+>', '', 'g')) AS t FROM (
    SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>.*?</li>')) AS li FROM pages)) WHERE length(t) >= 6 AND href <> '' GROUP BY 1) WHERE u >= 3""",
    d="score", i="page_id unique_hit hit date_hit",
)
def a16(spark, sf):
    return feeds.score_listing_selectors(fx.table(spark, sf, "pages"), article_only=False)
