"""Tables of raw feed payloads (JSON, JSONP, RSS/Atom, HTML listings) to raw news rows."""

import re
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.functions import defaults
from tickerloom.functions.codes import article_url_like, resolve_url

# JSON paths tried when the field map names none.
JSON_FALLBACKS = {
    "title": ["title", "新闻标题"],
    "content": ["content", "summary", "新闻内容"],
    "publish_time": ["publish_time", "pub_time", "date", "time", "发布时间"],
    "url": ["url", "link", "news_url", "新闻链接"],
    "source": ["source", "mediaName", "来源"],
}
JSON_LIST_KEYS = ["items", "list", "data", "result", "rows"]


def unwrap_jsonp(c: Column) -> Column:
    """Body of ``callback( ... )``; text that already is an object passes through."""
    t = F.trim(c)
    body = F.regexp_extract(t, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)
    return F.when(t.startswith("{"), t).otherwise(F.nullif(body, F.lit("")))


class Rule(NamedTuple):
    """A field rule, parsed once: a constant, or places to try in order, an attribute (HTML), and what stands in for nothing."""

    constant: str | None = None
    places: tuple = ()
    attribute: str = "text"
    default: str = ""

    @classmethod
    def parse(cls, rule, fallbacks=()):
        match rule:
            case None | "" | []:
                return cls(places=tuple(fallbacks))
            case str():
                return cls(places=(rule,))
            case list() | tuple():
                return cls(places=tuple(rule))
            case {"value": value}:
                return cls(constant=str(value or "").strip())
        single = [rule[k] for k in ("path", "field", "selector") if rule.get(k)][:1]
        return cls(
            places=(*single, *rule.get("paths", ())) or tuple(fallbacks),
            attribute=str(rule.get("attr") or "text").lower(),
            default=str(rule.get("default") or ""),
        )


def _variant_path(path: str) -> str:
    """a.b[0] in the notation of variant paths: names in quotes, places bare."""
    steps = (s for part in path.split(".") for s in part.replace("]", "").split("[") if s)
    return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)


def _text_at(item: Column, path: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(item, _variant_path(path), "string")), F.lit(""))


def _json_field(item: Column, rule, fallbacks) -> Column:
    r = Rule.parse(rule, fallbacks)
    return F.lit(r.constant) if r.constant is not None else F.coalesce(*[_text_at(item, p) for p in r.places], F.lit(r.default))


def normalize_json_feed(payloads: DataFrame, list_path: str = "", field_map: dict | None = None, source_name: str = "", col: str = "payload", as_of: str = "") -> DataFrame:
    """Rows (title, content, publish_time, source, url) of every item of every payload.

    Without a list path the root array or the first usual list key is taken. Items without a
    title go; a missing time becomes ``as_of``.
    """
    rules = field_map or {}
    root = F.try_parse_json(unwrap_jsonp(F.col(col))) if list_path else F.try_parse_json(
        F.when(F.trim(F.col(col)).startswith("["), F.col(col)).otherwise(unwrap_jsonp(F.col(col)))
    )
    get = lambda path: F.try_variant_get("_v", path, "array<variant>")
    if list_path:
        items = F.coalesce(get(_variant_path(list_path)), F.array(F.try_variant_get("_v", _variant_path(list_path), "variant")))
    else:
        items = F.coalesce(get("$"), *[get(f"$['{k}']") for k in JSON_LIST_KEYS])
    keep = [c for c in payloads.columns if c != col]
    rows = payloads.select(*keep, root.alias("_v")).select(*keep, F.explode(items).alias("_item"))
    field = lambda name: _json_field(F.col("_item"), rules.get(name), JSON_FALLBACKS[name])
    out = rows.select(*keep, *[field(n).alias(n) for n in ("title", "content", "publish_time", "source", "url")])
    out = out.filter(F.col("title") != "")
    return out.withColumns(
        {
            "publish_time": F.when(F.col("publish_time") == "", as_of).otherwise(F.col("publish_time")),
            "source": F.when(F.col("source") == "", source_name).otherwise(F.col("source")),
        }
    )


_LINK = "array<struct<_VALUE:string,_href:string>>"
_ITEM = (
    "struct<title:string,description:string,content:string,summary:string,`content:encoded`:string,"
    f"pubDate:string,published:string,updated:string,`dc:date`:string,source:string,author:string,link:{_LINK},guid:string,id:string>"
)
FEED_LISTS = ("", "channel", "items", "channel.items")  # where items stand below the root


def _feed_items(tags: list[str]) -> tuple[str, list[str]]:
    """Schema of a feed whose items have one of the tags, and the paths of its item lists."""
    if bad := [t for t in tags if not re.fullmatch(r"[\w:.-]+", t)]:
        raise ValueError(f"no tag names: {bad}")
    own = ", ".join(f"`{t}` array<{_ITEM}>" for t in tags)
    inner = own.replace("` array", "`: array")
    nested = {"channel", "items"} - set(tags)
    fields = [own]
    if "items" in nested:
        fields.append(f"items struct<{inner}>")
    if "channel" in nested:
        fields.append(f"channel struct<{inner}" + (f", items: struct<{inner}>>" if "items" in nested else ">"))
    lists = [p for p in FEED_LISTS if set(p.split(".")) - {""} <= nested]
    return ", ".join(fields), [f"d.{p + '.' if p else ''}`{t}`" for p in lists for t in tags]


def normalize_feed_xml(feeds: DataFrame, col: str = "xml", source_name: str = "", as_of: str = "", item_tag: str | None = None, feed_url: Column | str | None = None) -> DataFrame:
    """RSS items and Atom entries, or elements of ``item_tag``, as rows (title, content, publish_time, source, url).

    Links that do not begin with http are resolved against ``feed_url``, a text or a column.
    """
    keep = [c for c in feeds.columns if c != col]
    schema, lists = _feed_items([item_tag] if item_tag else ["item", "entry"])
    seen = F.lit(feed_url) if isinstance(feed_url, str) else feed_url
    base = F.lit("") if seen is None else F.coalesce(seen, F.lit(""))
    doc = feeds.select(*keep, base.alias("_base"), F.from_xml(F.col(col), schema).alias("d"))
    none = F.array().cast(f"array<{_ITEM}>")
    items = F.concat(*[F.coalesce(F.col(x), none) for x in lists])
    rows = doc.select(*keep, "_base", F.explode(items).alias("i"))
    text = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"i.`{n}`")), F.lit("")) for n in names], F.lit(""))
    link = F.get(F.col("i.link"), 0)
    url = F.coalesce(
        F.nullif(F.trim(link["_href"]), F.lit("")), F.nullif(F.trim(link["_VALUE"]), F.lit("")), F.nullif(text("guid", "id"), F.lit("")), F.lit("")
    )
    url = F.when((url == "") | url.startswith("http://") | url.startswith("https://"), url).otherwise(resolve_url(F.col("_base"), url))
    time, source = text("pubDate", "published", "updated", "dc:date"), text("source", "author")
    return rows.select(
        *keep,
        text("title").alias("title"),
        text("description", "content", "summary", "content:encoded").alias("content"),
        F.when(time == "", as_of).otherwise(time).alias("publish_time"),
        F.when(source == "", source_name).otherwise(source).alias("source"),
        url.alias("url"),
    ).filter(F.col("title") != "")


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def nested(self, enter=lambda node: True):
        """Children of all depths in document order, from a stack: pages nest as deep as they like."""
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            yield c
            if isinstance(c, _Node) and enter(c):
                stack += reversed(c.children)

    def walk(self):
        return (c for c in self.nested() if isinstance(c, _Node))

    def text(self):
        shown = (c.strip() for c in self.nested(lambda node: node.tag not in ("script", "style")) if isinstance(c, str))
        return " ".join(p for p in shown if p)


class _Tree(HTMLParser):
    VOID = {"br", "img", "meta", "link", "input", "hr", "source", "col", "base", "wbr", "area", "embed", "track"}
    CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.at.tag in self.CLOSES.get(tag, ()):
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _compounds(selector):
    """Descendant selector as (tag, id, classes) steps; other kinds of selectors are refused, not misread."""
    out = []
    for step in selector.split():
        if not re.fullmatch(r"(\*|[\w-]+)?([#.][\w-]+)*", step):
            raise ValueError(f"unsupported selector: {selector}")
        tag = re.match(r"[\w-]*", step).group().lower()
        ident = re.findall(r"#([\w-]+)", step)
        out.append((tag, ident[0] if ident else None, set(re.findall(r"\.([\w-]+)", step))))
    return out


def _fits(node, step):
    tag, ident, classes = step
    return (
        (not tag or node.tag == tag)
        and (ident is None or node.attrs.get("id") == ident)
        and classes <= set(node.attrs.get("class", "").split())
    )


def _select(scope, steps):
    for node in scope.walk():
        if not _fits(node, steps[-1]):
            continue
        rest, up = list(steps[:-1]), node.parent
        while rest and up is not None:
            if _fits(up, rest[-1]):
                rest.pop()
            up = up.parent
        if not rest:
            yield node


def _field(node, rule):
    """Text, attribute or constant of the first node that a rule's selector finds (the node itself without one)."""
    if rule is None:
        return ""
    r = Rule.parse(rule)
    if r.constant is not None:
        return r.constant
    found = next(_select(node, _compounds(r.places[0])), None) if r.places else node
    if found is None:
        return r.default
    return found.text() if r.attribute in ("text", "innertext", "content") else str(found.attrs.get(r.attribute, r.default)).strip()


def _absolute(base, url):
    try:
        return urljoin(base, url)
    except ValueError:
        return url


LISTING_FIELDS = {
    "title": {"selector": "a", "attr": "text"},
    "content": {"selector": "p", "attr": "text"},
    "publish_time": {"selector": "time", "attr": "text"},
    "url": {"selector": "a", "attr": "href"},
    "source": None,
}


def extract_listing_html(pages: DataFrame, item_selector: str, field_map: dict | None = None, source_name: str = "", as_of: str = "") -> DataFrame:
    """Listing rows of (page_id, url, html) pages, links resolved against the page.

    Parsing HTML has no built-in expression, so pages stream through ``mapInPandas`` batches.
    """
    rules = {**LISTING_FIELDS, **(field_map or {})}
    steps = _compounds(item_selector)

    def rows(batches):
        for batch in batches:
            out = []
            for pid, base, html in zip(batch["page_id"], batch["url"], batch["html"]):
                for pos, node in enumerate(_select(_Tree(html).root, steps)):
                    f = {k: _field(node, r) for k, r in rules.items()}
                    if not f["title"]:
                        continue
                    link = f["url"]
                    if link and not link.startswith(("http://", "https://")):
                        link = _absolute(base, link)
                    out.append((pid, pos, f["title"], f["content"], f["publish_time"] or as_of, f["source"] or source_name, link))
            yield pd.DataFrame(out, columns=["page_id", "pos", "title", "content", "publish_time", "source", "url"])

    schema = "page_id long, pos int, title string, content string, publish_time string, source string, url string"
    return pages.select("page_id", "url", "html").mapInPandas(rows, schema)


def listing_candidates(pages: DataFrame, items=defaults.ITEM_SELECTORS, titles=defaults.TITLE_SELECTORS, dates=defaults.DATE_SELECTORS) -> DataFrame:
    """One row per page, item selector and matching node: its link, title and date evidence."""
    steps = [(i, s, _compounds(s)) for i, s in enumerate(items)]
    title_steps = [(i, s, _compounds(s)) for i, s in enumerate(titles)]
    date_steps = [(i, s, _compounds(s)) for i, s in enumerate(dates)]
    date = re.compile(defaults.LISTING_DATE_PATTERN)

    def usable(node, sel):
        a = next(_select(node, sel), None)
        return a is not None and len(a.text()) >= 6 and a.attrs.get("href", "").strip() != ""

    def rows(batches):
        for batch in batches:
            out = []
            for pid, base, html in zip(batch["page_id"], batch["url"], batch["html"]):
                root = _Tree(html).root
                for prio, selector, sel in steps:
                    for pos, node in enumerate(_select(root, sel)):
                        good = [i for i, _, s in title_steps if usable(node, s)]
                        dated = []
                        for i, _, s in date_steps:
                            hit = next(_select(node, s), None)
                            if hit is not None and date.search(hit.text()):
                                dated.append(i)
                        link = ""
                        if good:
                            a = next(_select(node, title_steps[good[0]][2]))
                            link = _absolute(base, a.attrs["href"].strip())
                        out.append((pid, base, prio, selector, pos, link, date.search(node.text()) is not None, good, dated))
            yield pd.DataFrame(
                out, columns=["page_id", "url", "prio", "selector", "pos", "link", "has_date", "titles", "dates"]
            )

    schema = (
        "page_id long, url string, prio int, selector string, pos int, link string, has_date boolean,"
        " titles array<int>, dates array<int>"
    )
    return pages.select("page_id", "url", "html").mapInPandas(rows, schema)


def score_listing_selectors(pages: DataFrame, min_unique: int = 3, article_only: bool = True, items=defaults.ITEM_SELECTORS, titles=defaults.TITLE_SELECTORS, dates=defaults.DATE_SELECTORS) -> DataFrame:
    """(page_id, selector, score, unique_hit, hit, date_hit, title_selector, date_selector).

    Best selector of each page by unique article links, dated items and hits; every node counts.
    """
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    nodes = listing_candidates(pages, items, titles, dates)
    ok = F.col("link") != ""
    if article_only:
        ok = ok & article_url_like(F.col("link"), host)
    votes = lambda col, n: [F.count_if(F.array_contains(col, i)).alias(f"_{col}{i}") for i in range(n)]
    per = nodes.withColumn("_ok", ok).groupBy("page_id", "prio", "selector").agg(
        F.count_if("_ok").alias("hit"),
        F.count_distinct(F.when(F.col("_ok"), F.col("link"))).alias("unique_hit"),
        F.count_if(F.col("_ok") & F.col("has_date")).alias("date_hit"),
        *votes("titles", len(titles)),
        *votes("dates", len(dates)),
    )
    first_best = lambda col, names: F.array_max(
        F.array(*[F.struct(F.col(f"_{col}{i}").alias("n"), F.lit(-i).alias("o"), F.lit(s).alias("s")) for i, s in enumerate(names)])
    )["s"]
    points = F.col("unique_hit") + 0.35 * F.col("date_hit") + 0.02 * F.least(F.col("hit"), F.lit(100))
    w = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "prio")
    return (
        per.filter(F.col("unique_hit") >= min_unique)
        .select(
            "page_id", "prio", "selector", points.alias("score"), "unique_hit", "hit", "date_hit",
            first_best("titles", titles).alias("title_selector"),
            first_best("dates", dates).alias("date_selector"),
        )
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .drop("_rn", "prio")
    )
