"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, a plus before a digit, a digit before a
dot, digits, URL schemes and the cue of an account number. From each anchor a small deterministic
parser expands to both sides and validates what it finds. Anchors come in text order, so every kind
keeps one cursor and its spans are leftmost and non-overlapping; a parser never looks behind its
cursor, hence a text costs time in proportion to its length.

Kinds: email, ip, card, phone (the base kinds), then iban and login (a URL with user and password).

Defined cases: a null or empty text has no spans; repeated rows and ties are handled row by row;
an empty table gives an empty table; only the id and text columns are read, so extra columns of any
name do not matter.
"""

import hashlib

from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone", "iban", "login")
BASE = KINDS[:4]
DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
HOST = LABEL | frozenset(".")

_automaton = None


def automaton():
    """Anchors with their kinds; built once per Python worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        a.add_word("@", "email")
        a.add_word("://", "login")
        for cue in ("IBAN", "iban", "Iban"):
            a.add_word(cue, "iban")
        for d in "0123456789":
            a.add_word(d, "card")
            a.add_word(f"+{d}", "phone")
            a.add_word(f"{d}.", "ip")
        a.make_automaton()
        _automaton = a
    return _automaton


def run_of(text: str, at: int, chars: frozenset) -> int:
    """End of the run of ``chars`` that begins at ``at``."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def email_at(text: str, at: int, floor: int):
    """Local part to the left of the at-sign, two or more labels to its right."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_of(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (more := run_of(text, end + 1, LABEL)) > end + 1:
        end, labels = more, labels + 1
    return (start, end, True) if labels else None


def ip_at(text: str, dot: int, floor: int):
    """Four runs of digits joined by dots; the first one ends before ``dot``."""
    start = dot
    while start > floor and text[start - 1] in DIGITS:
        start -= 1
    if start == dot:
        return None
    end, parts = dot, [text[start:dot]]
    while len(parts) < 4:
        if end >= len(text) or text[end] != ".":
            return None
        more = run_of(text, end + 1, DIGITS)
        if more == end + 1:
            return None
        parts.append(text[end + 1 : more])
        end = more
    return start, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def card_at(text: str, start: int):
    """Digits with single blanks or hyphens between them."""
    n, end, got = len(text), start + 1, [text[start]]
    while end < n:
        if text[end] in DIGITS:
            step = 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            step = 2
        else:
            break
        end += step
        got.append(text[end - 1])
    if len(got) < 2:
        return None
    return start, end, 16 <= len(got) <= 19 and luhn("".join(got))


def phone_at(text: str, plus: int):
    """A plus, a digit, then at least one more mark and a last digit."""
    end = run_of(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3:
        return None
    return plus, end, 8 <= sum(c in DIGITS for c in text[plus:end]) <= 15


def iban_at(text: str, at: int):
    """Country, check digits and account after the cue, blanks allowed, remainder 1 modulo 97."""
    while at < len(text) and text[at] in " :.-#\t" and at < len(text):
        at += 1
    got, end, last = [], at, at
    while end < len(text) and len(got) < 34 and (text[end] in LETTERS or text[end] in DIGITS or text[end] == " "):
        if text[end] != " ":
            got.append(text[end].upper())
            if len(got) >= 15 and got[0] in LETTERS and got[1] in LETTERS and got[2] in DIGITS and got[3] in DIGITS:
                if int("".join(str(int(c, 36)) for c in got[4:] + got[:4])) % 97 == 1:
                    last = end + 1
        end += 1
    return (at, last, True) if last > at else None


def login_at(text: str, colon: int, floor: int):
    """scheme://user:password@host"""
    start = colon
    while start > floor and text[start - 1] in LETTERS:
        start -= 1
    user = run_of(text, colon + 3, LOCAL)
    if start == colon or user == colon + 3 or user >= len(text) or text[user] != ":":
        return None
    secret = run_of(text, user + 1, LOCAL | frozenset("!$&*=~"))
    if secret == user + 1 or secret >= len(text) or text[secret] != "@":
        return None
    end = run_of(text, secret + 1, HOST)
    return (start, end, True) if end > secret + 1 else None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by kind as listed and then by start."""
    if not text:
        return []
    cursor, found = dict.fromkeys(KINDS, 0), {k: [] for k in KINDS}
    for at, kind in automaton().iter(text):
        floor = cursor[kind]
        if kind == "card":
            got = card_at(text, at) if at >= floor else None
        elif kind == "ip":
            got = ip_at(text, at, floor)
        elif kind == "email":
            got = email_at(text, at, floor)
        elif kind == "phone":
            got = phone_at(text, at - 1)
        elif kind == "login":
            got = login_at(text, at - 2, floor)
        else:
            got = iban_at(text, at + 1)
        if got:
            cursor[kind] = got[1]
            if got[2]:
                found[kind].append((kind, got[0], got[1]))
    return [s for k in KINDS for s in found[k]]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str | None, spans=None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    spans = sorted((a, -b, k) for k, a, b in (find_spans(text) if spans is None else spans))
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, -b)
    return "".join(out) + text[done:]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text: id, a count per base kind, base_sha256, spans, n_spans."""

    def rows(cols):
        for key, text in zip(*cols, strict=True):
            spans = find_spans(text)
            base = [s for s in spans if s[0] in BASE]
            counts = [sum(s[0] == k for s in base) for k in BASE]
            yield (key, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return map_rows(docs.select(id_col, text_col), schema, rows)


def masked(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with personal data masked in the text and the length counted anew."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            i = b.schema.get_field_index(text_col)
            texts = pa.array([mask(t) for t in b.column(i).to_pylist()], pa.string())
            yield b.set_column(i, text_col, texts)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.char_length(F.col(text_col)).cast("long")) if length_col in docs.columns else out
