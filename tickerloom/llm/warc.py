"""WARC archives: records, revisits, segments, and their reassembly.

Writing: a page becomes one record. Of pages with equal payloads the one with the largest id is the
response, the others are revisits without a payload. A response block is an HTTP message in chunked
transfer framing. A block longer than SEGMENT bytes is cut: the first segment stays in the response
record, the rest are continuation records that name its id, a segment number from 2 and, in the last one, the
total length. Segments are rows of their own, dealt to files apart from each other, so no file or task has to
hold a long record. Spark's text writer puts CR LF CR LF after each record, which is the format's own separator.

Reading: files are scanned whole, one at a time per task (a file has a bounded number of records of bounded
length). Whole records go on; segments are grouped by their origin, ordered by number, checked for gaps and
against the total length, joined, and only then is the chunked framing decoded and the digest computed.
A revisit gets length and digest from its own headers and names its response.

Defined cases: a null payload counts as empty; an empty payload is a response or revisit like any other; a null
URL is written as a URN of the page; rows that repeat an id and its payload are both of the kind that
id has; a null id never is a response while an equal payload has an id; an empty table gives an
empty archive; extra columns are not read. A record that cannot be reassembled (gap, wrong total, broken
framing) is kept with the reason in ``fault`` and without a payload.
"""

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom.llm.common import bounded_batches, shared_path, stored

SEGMENT, CHUNK = 48_000, 8_192
FILE_RECORDS = 400
DATE = "2000-01-01T00:00:00Z"  # archives of equal pages are equal
END = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def framed(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x" % len(part), END, part, END]
    return b"".join([*out, b"0", END, END])


def unframed(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(END, at)
        size = int(body[at:line].split(b";")[0].strip() or b"x", 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != END:
            raise ValueError("a chunk does not end where it should")
        out.append(body[at : at + size])
        at += size + 2


def http_message(payload: bytes) -> bytes:
    return END.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Transfer-Encoding: chunked", b"", b""]) + framed(payload)


def record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    head += [f"{k}: {v}" for k, v in fields] + [f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block


def page_records(name: str, page: str, url: str | None, payload: bytes, refers: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of a page: a revisit, or a response and its continuations."""
    safe = "".join(c for c in (url or f"urn:page:{page}") if c > " " and c != "\x7f")
    fields = [("WARC-Target-URI", safe), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers}#{digest(payload)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [record("revisit", name, [*fields, ("X-Payload-Length", str(len(payload)))], b"")]
    block = http_message(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if len(parts) == 1:
        return [record("response", name, fields, block)]
    out = [record("response", name, [*fields, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Target-URI", safe), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k))]
        if k == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record("continuation", f"{name[:-1]}/{k}>", more, part))
    return out


def parse(data: bytes):
    """(fields, block) of every record of a file; lengths, not separators, end a block."""
    at, n = 0, len(data)
    while at < n:
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record starts here")
        fields = {}
        for line in lines[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        start = head + 4
        end = start + int(fields["content-length"])
        yield fields, data[start:end]
        at = end + 4


def record_rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str, segment: int) -> DataFrame:
    """(record): every record of the archive as one binary row."""
    pages = pages.select(F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    key = F.sha1("payload")
    pairs = pages.select("id", key.alias("_key")).groupBy("_key", "id").agg(F.count("*").alias("m"))
    first = pairs.groupBy("_key").agg(F.max("id").alias("owner"), F.max_by("m", "id").alias("owners"))
    rows = pages.join(first, key == F.col("_key")).select("page", "url", "payload", F.when(F.col("owner").isNull() | F.col("id").eqNullSafe(F.col("owner")), F.lit(None)).otherwise(F.col("owner")).cast("string").alias("refers"), F.coalesce((F.col("id") == F.col("owner")) & (F.col("owners") == 1), F.lit(False)).alias("referred"))

    def run(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for page, url, payload, refers, referred in zip(*[c.to_pylist() for c in b.columns], strict=True):
                # the response that revisits refer to is named by page and payload; a place keeps the others apart, also where ids repeat
                name = f"<urn:page:{'' if page is None else page}#{digest(payload)}{'' if referred else f'.{task}.{n}'}>"
                n += 1
                out += page_records(name, "" if page is None else page, url, payload, refers, segment)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return rows.mapInArrow(run, "record binary")


def write_archive(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT) -> None:
    """Archive files of at most FILE_RECORDS records below ``out``."""
    bounded_batches(pages.sparkSession)
    rows = record_rows(pages, id_col, url_col, payload_col, segment)
    text = rows.select(F.col("record").cast("string").alias("value"))  # bytes stay as they are
    text.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(out)


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """(kind, name, origin, segment, total, refers, digest, length, block) of every record of the archive files."""
    schema = "kind string, name string, origin string, segment int, total long, refers string, digest string, length long, block binary"

    def run(batches):
        import gzip

        for b in batches:
            for data in b.column(0).to_pylist():
                rows, size = [], 0
                for f, block in parse(gzip.decompress(data)):
                    total = f.get("warc-segment-total-length")
                    rows.append(
                        {
                            "kind": f["warc-type"], "name": f["warc-record-id"], "origin": f.get("warc-segment-origin-id"),
                            "segment": int(f["warc-segment-number"]) if "warc-segment-number" in f else None, "total": int(total) if total else None,
                            "refers": f.get("warc-refers-to"), "digest": f.get("warc-payload-digest"),
                            "length": int(f["x-payload-length"]) if "x-payload-length" in f else None, "block": block,
                        }
                    )
                    size += len(block)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return spark.read.format("binaryFile").load(f"{out}/part-*").select("content").mapInArrow(run, schema)


def reassemble(records: DataFrame) -> DataFrame:
    """(name, block, fault): segments joined by origin in order of their numbers; whole records pass by without a shuffle."""
    whole = records.filter(F.col("segment").isNull()).select("name", "kind", "refers", "digest", "length", "block", F.lit(None).cast("string").alias("fault"))
    parts = records.filter(F.col("segment").isNotNull())
    origin = F.coalesce("origin", "name").alias("name")
    groups = parts.groupBy(origin).agg(
        F.max(F.when(F.col("segment") == 1, F.col("kind"))).alias("kind"),
        F.max("refers").alias("refers"),
        F.max("digest").alias("digest"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")  # bytes stay as they are; one pass
    gap = F.col("parts.segment") != F.sequence(F.lit(1), F.size("parts"))
    joined = groups.withColumn("block", block).withColumn(
        "fault",
        F.when(F.col("total").isNull(), "no total length")
        .when(gap, "a segment is missing or repeated")
        .when(F.octet_length("block") != F.col("total"), "the total length does not match"),
    )
    return whole.unionByName(joined.select("name", "kind", "refers", "digest", F.lit(None).cast("long").alias("length"), "block", "fault"))


def payload_rows(records: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, fault): framing decoded, digests computed from what was read."""

    def page_of(name: str):
        got = name.strip("<>").removeprefix("urn:page:").partition("#")[0]
        return int(got) if got else None

    def run(batches):
        for b in batches:
            rows = []
            for name, kind, refers, stated, length, block, fault in zip(*[c.to_pylist() for c in b.columns], strict=True):
                told = (stated or "").removeprefix("sha1:")
                if kind == "revisit":
                    rows.append((page_of(name), length, told, kind, page_of(refers), fault))
                    continue
                size = got = None
                if not fault:
                    try:
                        payload = unframed(block[block.index(b"\r\n\r\n") + 4 :])
                        size, got = len(payload), digest(payload)
                        fault = None if got == told else "the digest does not match"
                    except ValueError as e:
                        fault = str(e)
                rows.append((page_of(name), size, got, kind, None, fault))
            if rows:
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault"]
    columns = records.select("name", "kind", "refers", "digest", "length", "block", "fault")
    return columns.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, fault string")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT) -> DataFrame:
    """Write the archive to the shared folder, read it back, reassemble, decode."""
    spark = pages.sparkSession
    out = shared_path(spark, "warc")
    write_archive(pages, out, id_col, url_col, payload_col, segment)
    return payload_rows(reassemble(read_records(spark, out)))


# base32 of a SHA-1: eight digits of five bits for each of four 40-bit groups
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS owner FROM p),
b AS (SELECT page_id, payload_bytes, owner,
        list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          1 + ((('0x' || substr(x, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to FROM b
"""
