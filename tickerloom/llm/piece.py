"""Merge-type subword encoding by a prefix table, and decoding.

For a text chunk the table stores, for every prefix, the one last token of that prefix's encoding.
An Aho-Corasick automaton over the vocabulary lists the tokens that end at a position; such a token t
is the last one if the table entry before it, p, and t are compatible, that is if the two-token text
encodes to exactly (p, t). Compatibility of neighbours decides a whole encoding, because the first
merge that crosses a boundary would also happen between the two tokens alone. Exactly one token
passes at each position, and the ids are recovered from the end backwards.

The vocabulary file is a parameter: its pieces and scores are read with the library, encoding and
decoding are done here. Merges follow the scores: the best-scored adjacent pair first, the leftmost of equals.

No piece has the blank mark after another character (checked when the file is read), so no merge
crosses the start of a run of blank marks; chunks are cut there and around characters that are in no
piece, and repeated chunks of a worker are looked up in a bounded memory.

Defined cases: a null or empty text encodes to the end id alone and decodes to an empty text; blank
runs, line ends, unknown characters (byte pieces) and very long chunks take the same path; rows are
handled one by one, so ties, repeats, empty tables and extra columns do not matter.
"""

import hashlib
import re

from pyspark.sql import DataFrame

from tickerloom.llm.common import map_rows

BLANK = "▁"
REMEMBERED = 250_000  # chunks a worker remembers
LONGEST = 48  # longer chunks are not remembered


class PieceTable:
    """Pieces, automaton and compatibility memory of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.end_id = sp.eos_id()
        normal = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.id_of = {self.pieces[i]: i for i in normal}
        self.score = {self.pieces[i]: sp.get_score(i) for i in normal}
        if any(BLANK in p.lstrip(BLANK) for p in self.id_of):
            raise ValueError("pieces with an inner blank mark are not supported")
        self.chars = {p for p in self.id_of if len(p) == 1}
        cut = "".join(c for c in "\n\r\t" if not any(c in p for p in self.id_of))
        self.chunks = re.compile(f"{BLANK}+[^{BLANK}{cut}]*|[^{BLANK}{cut}]+" + (f"|[{cut}]" if cut else "")).findall
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if self.merge(p) == [p]:  # a piece that its own characters never merge to is no token
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Merges as defined, on a short text."""
        parts, score, none = list(text), self.score, -1e30
        gains = [score.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while gains:
            best = max(gains)
            if best == none:
                break
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score.get(parts[i - 1] + parts[i], none)
            if i < len(gains):
                gains[i] = score.get(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        fit = self.fits.get(key)
        if fit is None:
            a, b = self.pieces[left], self.pieces[right]
            fit = self.fits[key] = self.merge(a + b) == [a, b]
            if len(self.fits) > 700_000:
                self.fits = {}
        return fit

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk. last[i]: the last token of the prefix of i characters, -1 for a character in no piece."""
        n = len(chunk)
        last, size = [-2] * (n + 1), [1] * (n + 1)
        fits, compatible = self.fits, self.compatible
        for end, (token, length) in self.automaton.iter(chunk):
            end += 1
            if last[end] != -2:
                continue
            start = end - length
            before = last[start]
            if before == -2 and start:  # unreached: the character there is in no piece
                before = -1
            if before < 0 or (fits[before, token] if (before, token) in fits else compatible(before, token)):
                last[end], size[end] = token, length
        ids, at = [], n
        while at:
            token = last[at]
            if token < 0:
                ids.extend(self.byte_id[b] for b in reversed(chunk[at - 1].encode("utf-8", "replace")))
            else:
                ids.append(token)
            at -= size[at]
        ids.reverse()
        return ids

    def decode_ids(self, ids) -> str:
        """Pieces joined, byte pieces read as UTF-8, blank marks as blanks; the first text keeps its blank."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(BLANK, " ")

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        ids = self.encode_chunk(chunk)
        got = (len(ids), " ".join(map(str, ids)), self.decode_ids(ids))
        if len(chunk) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[chunk] = got
        return got

    def cut(self, text: str) -> list[str]:
        return self.chunks(BLANK + text.replace(" ", BLANK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.cut(text or "") for i in self.encode_chunk(c)] + [self.end_id]

    def decode(self, ids) -> str:
        text = self.decode_ids(ids)
        return text[1:] if text.startswith(" ") else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, ids as text, decoded text), the same as encode and decode, chunk by chunk."""
        known, chunk = self.known, self.chunk
        got = [known.get(c) or chunk(c) for c in self.cut(text or "")]
        ids = " ".join([g[1] for g in got] + [str(self.end_id)])
        decoded = "".join([g[2] for g in got])
        return sum([g[0] for g in got]) + 1, ids, decoded[1:] if decoded.startswith(" ") else decoded


_tables: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """Built once per Python worker."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): whole texts as ids, end id last."""
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        t = piece_table(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.encode(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids)."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def rows(cols):
        t = piece_table(path)
        return [(k, t.decode(ids or [])) for k, ids in zip(*cols, strict=True)]

    return map_rows(tokens.select(id_col, ids_col), f"`{id_col}` {kind}, text string", rows)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: id, n_tokens, ids_sha256, decoded_sha256, same_text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(cols):
        t = piece_table(path)
        for key, text in zip(*cols, strict=True):
            n, ids, decoded = t.digest(text)
            yield key, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest(), decoded == (text or "")

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean"
    return map_rows(docs.select(id_col, text_col), schema, rows)
