"""Column expressions for stock codes, source ids and URLs."""

from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.functions import defaults


def pad_code(c: Column) -> Column:
    """Trim and left-pad with zeros to six; longer codes are left as they are."""
    t = F.trim(c.cast("string"))
    return F.when(F.length(t) < 6, F.lpad(t, 6, "0")).otherwise(t)


def digits_code(c: Column) -> Column:
    """Digits only, padded or cut (from the right) to six; NULL without digits."""
    d = F.regexp_replace(c.cast("string"), r"\D", "")
    padded = F.when(F.length(d) > 6, F.right(d, F.lit(6))).otherwise(F.lpad(d, 6, "0"))
    return F.when(F.length(d) > 0, padded)


def exchange_code(c: Column) -> Column:
    """Prefix with the exchange: sh for codes starting with 6, else sz."""
    return F.concat(F.when(c.startswith("6"), "sh").otherwise("sz"), c)


def valid_code(c: Column) -> Column:
    return c.rlike(r"^[0-9]{6}$")


def slug(c: Column, max_len: int = 40) -> Column:
    """Lower-case identifier of [a-z0-9_-]."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9_-]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, r"_+", "_"), r"^_+|_+$", "")
    return F.substring(s, 1, max_len)


def strip_company_suffix(c: Column, suffixes=defaults.COMPANY_SUFFIXES) -> Column:
    """Strip each suffix once, in order, while something is left."""
    out = F.trim(c)
    for s in suffixes:
        out = F.regexp_replace(out, rf"(?s)(?<=.)\Q{s}\E\z", "")
    return F.trim(out)


def normalize_url(c: Column) -> Column:
    """http(s) URL without query and fragment, host lower-cased; '' when invalid."""
    t = F.trim(F.coalesce(c, F.lit("")))
    t = F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(t)
    shape = r"(?s)^(https?)://([^/?#]+)([^?#]*)"
    path = F.regexp_replace(F.regexp_extract(t, shape, 3), r";[^/]*$", "")
    url = F.concat(
        F.regexp_extract(t, shape, 1), F.lit("://"), F.lower(F.regexp_extract(t, shape, 2)), path
    )
    return F.when(t.rlike(shape), F.regexp_replace(url, r"/+$", "")).otherwise("")


def news_id(title: Column, ts: Column, url: Column) -> Column:
    """First 12 hex digits of the md5 of title, second-precision time and URL."""
    stamp = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    seed = F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(stamp, F.lit("")), F.coalesce(url, F.lit("")))
    return F.substring(F.md5(seed), 1, 12)


def url_host(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved; what leads above the root stays at the root."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda held, x: F.when(x == ".", held).when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))).otherwise(F.concat(held, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1), step)
    return F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def resolve_url(base: Column, link: Column) -> Column:
    """A link as seen from the page ``base``: absolute links stay, others take scheme, host and folder from the base."""
    shape = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
    b, r = F.trim(F.coalesce(base, F.lit(""))), F.trim(F.coalesce(link, F.lit("")))
    of = lambda c, k: F.regexp_extract(c, shape, k)
    host, path = of(b, 2), of(r, 3)
    folder = F.when((of(b, 3) == "") & (host != ""), "/").otherwise(F.regexp_extract(of(b, 3), r"(?s)^(.*/)?", 0))
    whole = _without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)))
    own = F.concat(of(b, 1), host)
    joined = (
        F.when(of(r, 2) != "", F.concat(of(b, 1), r))
        .when(path != "", F.concat(own, whole, of(r, 4), of(r, 5)))
        .when(of(r, 4) != "", F.concat(own, of(b, 3), of(r, 4), of(r, 5)))
        .otherwise(F.concat(own, of(b, 3), of(b, 4), of(r, 5)))
    )
    return F.when(r == "", b).when((b == "") | (of(r, 1) != ""), r).otherwise(joined)


def article_url_like(url: Column, host: Column | None = None) -> Column:
    """URL of an article page, optionally on the given host."""
    netloc = url_host(url)
    shape = "(?i)" + "|".join(f"(?:{p})" for p in defaults.ARTICLE_URL_PATTERNS)
    ok = (netloc != "") & url.rlike(shape)
    if host is not None:
        ok = ok & ((host == "") | netloc.contains(host))
    return F.coalesce(ok, F.lit(False))


def resolve_source(df: DataFrame, source_dim: DataFrame, alias_dim: DataFrame, col: str = "source") -> DataFrame:
    """+source_id: 'all', exact id, name match, alias, else the first enabled source.

    source_dim: (source_id, name, enabled, sort_order); alias_dim: (alias, target).
    """
    raw = F.trim(F.coalesce(F.col(col), F.lit("")))
    first = lambda cond: F.min_by("source_id", F.when(cond, F.struct("sort_order", "source_id")))
    default = source_dim.agg(
        F.coalesce(first(F.col("enabled")), first(F.lit(True)))
    ).scalar()
    ids = source_dim.select(F.col("source_id").alias("_by_id")).distinct()
    names = source_dim.groupBy(F.lower(F.trim("name")).alias("_name")).agg(
        F.min_by("source_id", F.struct("sort_order", "source_id")).alias("_by_name")
    )
    aliases = (
        alias_dim.join(ids, alias_dim["target"] == F.col("_by_id"), "left_semi")
        .groupBy(F.col("alias").alias("_alias"))
        .agg(F.min("target").alias("_by_alias"))
    )
    return (
        df.withColumn("_raw", raw)
        .join(ids, slug(F.col("_raw")) == F.col("_by_id"), "left")
        .join(names, F.lower("_raw") == F.col("_name"), "left")
        .join(aliases, F.col("_raw") == F.col("_alias"), "left")
        .withColumn(
            "source_id",
            F.when(F.col("_raw") == "", default)
            .when(F.lower("_raw").isin("all", "全部", "全部来源"), "all")
            .otherwise(F.coalesce("_by_id", "_by_name", "_by_alias", default)),
        )
        .drop("_raw", "_by_id", "_name", "_by_name", "_alias", "_by_alias")
    )
