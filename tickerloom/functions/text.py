"""Column expressions that score news text. Lexicons are arguments."""

import re

from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.functions import defaults
from tickerloom.functions.codes import normalize_url
from tickerloom.functions.maths import clip, ratio, round_half_up, total


def strip_html(c: Column) -> Column:
    """Remove tags and collapse white space."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(bare, r"[\s　 ]+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case, letters, digits and underscores only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", "")


def merged_text(title: Column, content: Column) -> Column:
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))))


def count_of(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    gone = F.length(F.replace(text, F.lit(term), F.lit("")))
    return ((F.length(text) - gone) / F.lit(len(term))).cast("long")


def contains_any(text: Column, terms) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | text.contains(t)
    return hit


def classify_categories(text: Column, category_terms=defaults.CATEGORY_TERMS, other=defaults.OTHER_CATEGORY) -> Column:
    """Categories with any keyword in the text, in table order; [other] if none."""
    hits = F.array_compact(
        F.array(*[F.when(contains_any(text, terms), F.lit(name)) for name, terms in category_terms.items()])
    )
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(other)))


def affected_sectors(text: Column, sector_terms=defaults.SECTOR_TERMS, head: int = 100) -> Column:
    """Map of sector -> 0.8 if its first keyword found is in the head of the text, else 0.5."""
    start = F.substring(text, 1, head)
    entries = []
    for sector, terms in sector_terms.items():
        weight = F.lit(None).cast("double")
        for t in reversed(terms):
            weight = F.when(text.contains(t), F.when(start.contains(t), 0.8).otherwise(0.5)).otherwise(weight)
        entries.append(
            F.when(weight.isNotNull(), F.struct(F.lit(sector).alias("key"), weight.alias("value")))
        )
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def _lookback(words, width: int) -> str:
    """Regex alternation: one of the words lies wholly within the last ``width`` characters."""
    return "|".join(
        rf"{re.escape(w)}.{{0,{width - len(w)}}}" for w in sorted(words) if 0 < len(w) <= width
    )


def _marked_hits(text: Column, word: str, *contexts: str) -> Column:
    """Non-overlapping hits of a word that have every one of the contexts before them."""
    w = re.escape(word)
    behind = "".join(rf"(?<=(?:{c}){w})" for c in contexts)
    found = F.regexp_extract_all(text, F.lit(rf"(?s)({w}){behind}|{w}"), 1)
    return F.size(F.filter(found, lambda x: x != ""))


def context_modifier(context: Column, negation=defaults.NEGATION_WORDS, intensify=defaults.INTENSIFY_WORDS) -> Column:
    """-1 after a negation, 1.2 times as strong after an intensifier."""
    return F.when(contains_any(context, negation), -1.0).otherwise(1.0) * F.when(
        contains_any(context, intensify), 1.2
    ).otherwise(1.0)


def hit_strength(text: Column, word: str, negation=defaults.NEGATION_WORDS, intensify=defaults.INTENSIFY_WORDS, width: int = 8) -> Column:
    """Sum of the context modifiers over all hits of a word: each looks at the ``width`` characters before it."""
    neg, inten = _lookback(negation, width), _lookback(intensify, width)
    hits = count_of(text, word)
    n = _marked_hits(text, word, neg) if neg else F.lit(0)
    i = _marked_hits(text, word, inten) if inten else F.lit(0)
    both = _marked_hits(text, word, neg, inten) if neg and inten else F.lit(0)
    # plain + 1.2 (i - both) - (n - both) - 1.2 both, with plain = hits - n - i + both
    return hits - 2.0 * n + 0.2 * i - 0.4 * both


def keyword_sentiment(
    text: Column,
    title: Column,
    positive=None,
    negative=None,
    negation=defaults.NEGATION_WORDS,
    intensify=defaults.INTENSIFY_WORDS,
    width: int = 8,
) -> Column:
    """tanh of a quarter of the summed, context-adjusted word weights.

    Each hit counts -1 when a negation stands in the ``width`` characters before it and 1.2
    times when an intensifier does. Both are counted by bounded look-behind, so no text is
    exploded and words that do not occur cost one substring search.
    """
    positive = defaults.POSITIVE_WORDS if positive is None else positive
    negative = defaults.NEGATIVE_WORDS if negative is None else negative
    parts = []
    for sign, words in ((1.0, positive), (-1.0, negative)):
        for word, weight in words.items():
            strength = hit_strength(text, word, negation, intensify, width)
            boost = F.when(title.contains(word), 1.15).otherwise(1.0)
            parts.append(
                F.when(text.contains(word), F.lit(sign * weight) * boost * strength).otherwise(0.0)
            )
    return F.tanh(total(parts) / 4.0)


def semantic_sentiment(
    text: Column,
    title: Column,
    positive=defaults.POSITIVE_PATTERNS,
    negative=defaults.NEGATIVE_PATTERNS,
    uncertain=defaults.UNCERTAIN_WORDS,
) -> Column:
    """Balance of positive and negative phrases, damped by uncertain words."""

    def hits(patterns):
        return total(
            [count_of(text, p) + F.when(text.contains(p) & title.contains(p), 1).otherwise(0) for p in patterns]
        )

    pos, neg = hits(positive), hits(negative)
    doubt = total([count_of(text, w) for w in uncertain])
    scale = F.greatest(F.lit(0.5), 1.0 - 0.08 * doubt)
    return clip(ratio(pos - neg, pos + neg) * scale, -1.0, 1.0)


def hybrid_sentiment(text: Column, title: Column, double_title: bool = True, digits: int = 3, **lexicon) -> Column:
    """0.6 keyword + 0.4 phrase sentiment; the title is prepended once more by default."""
    merged = F.trim(F.concat(title, F.lit(" "), text)) if double_title else text
    kw = {k: lexicon[k] for k in ("positive", "negative", "negation", "intensify") if k in lexicon}
    sem = {
        k: lexicon[n]
        for k, n in (("positive", "positive_patterns"), ("negative", "negative_patterns"), ("uncertain", "uncertain"))
        if n in lexicon
    }
    score = 0.6 * keyword_sentiment(merged, title, **kw) + 0.4 * semantic_sentiment(merged, title, **sem)
    return round_half_up(clip(score, -1.0, 1.0), digits)


def importance(title: Column, content: Column, title_terms=defaults.IMPORTANT_TITLE_WORDS) -> Column:
    """0.5 plus title words, length and figures, at most 1."""
    words = total([F.when(title.contains(t), 0.1).otherwise(0.0) for t in title_terms])
    long = F.when(F.length(content) > 200, 0.1).otherwise(0.0)
    figure = F.when(content.rlike(r"\d+[.%亿万元]"), 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), round_half_up(0.5 + words + long + figure, 2))


def news_quality_score(content: Column, imp: Column, url: Column) -> Column:
    """Length of the content plus 120 per importance plus 15 for a valid URL."""
    return (
        F.length(F.coalesce(content, F.lit("")))
        + F.coalesce(imp, F.lit(0.0)) * 120.0
        + F.when(normalize_url(url) != "", 15.0).otherwise(0.0)
    )


PLACES = 1 << 16  # places of a text that one generated array holds


def wide(text: Column) -> Column:
    """The text as four bytes a character, in which any place is reached at once."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-32")


def wide_length(c: Column) -> Column:
    return F.floor(F.octet_length(c) / 4).cast("int")


def wide_slice(c: Column, at: Column, n: Column) -> Column:
    """n characters from place ``at`` (from 0) of a wide text."""
    return F.substring(c, at * 4 + 1, n * 4)


def each_place(df: DataFrame, text: str, at: str = "_at") -> DataFrame:
    """A row per place of a wide text, from 0; places come from arrays of bounded size, never from one of all grams."""
    n = wide_length(F.col(text))
    pieces = F.explode_outer(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(PLACES)))
    rows = df.select(*df.columns, pieces.alias("_piece"))
    within = F.explode_outer(F.sequence(F.col("_piece"), F.least(F.col("_piece") + (PLACES - 1), F.greatest(n - 1, F.lit(0)))))
    return rows.select(*df.columns, within.alias(at))
