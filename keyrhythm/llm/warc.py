"""WARC archives: written as one gzip member per record, read back by splits.

Writing: rows become gzip members in their tasks; Spark's text writer puts the bytes into files, so
its commit protocol takes care of repeated and lost tasks. Behind each block of members it writes an
empty gzip member, which readers of concatenated members skip.

Reading: a task gets a range of bytes. It looks for gzip magic, takes a candidate for a member only
if its header decodes to a WARC header and the members behind it follow one another, and owns the records that start inside its range, reading on past the end for the last one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyrhythm.llm.registry import query, table
from keyrhythm.session import new_folder

MAGIC = b"\x1f\x8b\x08"
GZIP = 31
#: An empty member, written as the text writer's line separator.
EMPTY = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
PIECE = 1 << 18
RECORD = ("warc_file string, warc_offset bigint, record_id string, record_type string, refers_to string, target_uri string, "
          "payload_digest string, payload_bytes bigint, payload binary")


def plan_records(pages: DataFrame, page_id: str, payload: str, least: int, salts: int) -> DataFrame:
    """Add ``_digest``, ``_bytes``, ``_revisits`` (the id whose record holds the same payload, or NULL).

    Copies of one payload may be a third of all rows: only digests with copies are joined, and the
    pages are dealt over ``salts`` copies of them.
    """
    marked = pages.withColumns({
        "_digest": F.sha1(F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")),
        "_bytes": F.octet_length(F.coalesce(F.col(payload), F.lit(""))).cast("bigint")})
    copies = (marked.where(F.col("_bytes") >= least).groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_n"), F.max(page_id).alias("_first")).where("_n > 1").drop("_n"))
    copies = copies.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    out = marked.withColumn("_salt", F.pmod(F.xxhash64(page_id), F.lit(salts)).cast("int")).join(copies, ["_digest", "_salt"], "left")
    revisits = F.when(~F.col(page_id).eqNullSafe(F.col("_first")), F.col("_first"))
    return out.withColumn("_revisits", revisits).drop("_salt", "_first")


def member(record_id, uri, html: str | None, digest: str, size: int, revisits, level: int) -> bytes:
    """One record as a gzip member. A revisit carries the HTTP header alone."""
    body = b"" if revisits is not None else (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    clean = "".join(c if c not in "\r\n" else " " for c in uri or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if revisits is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    if revisits is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{revisits}>"]
    packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n") + packer.flush()


def write_warc(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    least_revisit: int = 1000, salts: int = 16, level: int = 6, block: int = 1 << 22,
) -> None:
    """Write a record per row below ``folder``.

    Of rows with equal payloads (``html`` in UTF-8; NULL is empty) of ``least_revisit`` bytes or more,
    those with the largest id are response records, the others revisit it. A NULL id has an empty
    record id and is smaller than any other. Rows that repeat an id are records of their own. Other
    columns are not archived. An empty table gives a folder without records.
    """
    planned = plan_records(pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html")),
                           "_id", "_html", least_revisit, salts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("_id", "_url", "_html", "_digest", "_bytes", "_revisits"))):
                held.append(member(*(v.as_py() for v in row), level))
                size += len(held[-1])
                if size >= block:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    packed = planned.select("_id", "_url", "_html", "_digest", "_bytes", "_revisits").mapInArrow(pack, "value binary")
    (packed.select(F.col("value").cast("string")).write.option("lineSep", EMPTY).option("encoding", "ISO-8859-1").text(folder))


class _Bytes:
    """A file's bytes from an offset on, fetched piece by piece; what lies before ``drop`` is let go."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data, self.ended = file, start, bytearray(), False
        file.seek(start)

    def until(self, at: int) -> bool:
        """Fetch up to the absolute offset ``at``; False if the file ends before."""
        while self.base + len(self.data) < at and not self.ended:
            piece = self.file.read(PIECE)
            self.ended = not piece
            self.data += piece
        return self.base + len(self.data) >= at

    def find_magic(self, at: int, end: int) -> int | None:
        """The first gzip magic that starts in [at, end)."""
        self.until(end + len(MAGIC) - 1)
        found = self.data.find(MAGIC, at - self.base, end - self.base + len(MAGIC) - 1)
        return None if found < 0 else self.base + found

    def drop(self, before: int) -> None:
        if before - self.base > PIECE:
            del self.data[: before - self.base]
            self.base = before


def decode(source: _Bytes, at: int) -> tuple[bytes, int] | None:
    """(content, offset behind it) of the member at ``at``, or None if there is none.

    A wrong candidate fails at its header, its first bytes (no WARC header), or its check sum.
    """
    unpacker = zlib.decompressobj(GZIP)
    out: list[bytes] = []
    known, checked = 0, False
    try:
        while not unpacker.eof:
            if not source.until(at + 1):
                return None
            piece = bytes(source.data[at - source.base : at - source.base + PIECE])
            out.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
            known += len(out[-1])
            if known >= 5 and not checked:
                checked = True
                if b"".join(out)[:5] != b"WARC/":
                    return None
    except zlib.error:
        return None
    return b"".join(out), at


def follows(source: _Bytes, at: int) -> bool:
    """At ``at`` there is another member or the file's end, so the member before it was no chance find."""
    return not source.until(at + 1) or (source.until(at + 3) and source.data[at - source.base : at - source.base + 3] == MAGIC)


def trusted(source: _Bytes, at: int, end: int) -> bool:
    """Whether the member at ``at`` is one of the file's own.

    One that lies uncompressed inside another member's payload decodes as well; but its chain of
    members breaks off with other bytes before the range ends. A damaged member, with magic but
    undecodable, proves nothing against those before it.
    """
    first = at
    while at < end:
        got = decode(source, at)
        if got is None:
            return at > first
        if not follows(source, got[1]):
            return False
        at = got[1]
    return True


def records(source: _Bytes, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end)."""
    at, known = source.find_magic(start, end), start == 0
    while at is not None and at < end:
        known = known or trusted(source, at, end)
        got = decode(source, at) if known else None
        if got is None:
            at, known = source.find_magic(at + 1, end), False
            continue
        if got[0]:
            yield at, got[0]
        source.drop(got[1])
        at = source.find_magic(got[1], end) if got[1] < end else None


def parse(content: bytes) -> dict:
    """A record's fields. The payload is what follows the HTTP header; a revisit has none.

    Field names count in any case. A length that is no number counts as missing: what is there is taken.
    """
    head, _, block = content.partition(b"\r\n\r\n")
    fields = _fields(head.decode("utf-8", "replace"))
    block = block[: _length(fields, len(block))]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").lower().startswith("application/http") else (b"", b"", block)
    told = _fields(http.decode("latin-1"))
    return {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest"),
        "payload_bytes": _length(told, len(payload)), "payload": payload,
    }


def _fields(head: str) -> dict[str, str]:
    """Header lines behind the first, by their names in lower case."""
    named = (line.partition(":") for line in head.split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in named if colon}


def _length(fields: dict[str, str], there: int) -> int:
    told = fields.get("content-length", "")
    return int(told) if told.isascii() and told.isdigit() and len(told) < 19 else there


def _file_system(path: str):
    """Spark writes local paths as file:/x; the file system library wants file:///x."""
    scheme, colon, rest = path.partition(":/")
    return fs.FileSystem.from_uri(f"{scheme}:///{rest.lstrip('/')}" if colon and not rest.startswith("/") else path)


def read_warc(spark: SparkSession, folder: str, split_bytes: int = 8 << 20, batch_bytes: int = 8 << 20,
              most_tasks: int = 100_000) -> DataFrame:
    """All records below ``folder``: file, offset, header fields and payload.

    Files are cut into ranges of ``split_bytes``, dealt over as many tasks (``most_tasks`` at most),
    whatever the files' number and sizes. The files must lie where the tasks' file system library
    reaches them. A member nested without compression inside another is told apart unless it fills a
    whole range. Empty files have no records; a folder without files is an error of Spark's reader.
    Header fields that a record lacks are NULL.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")
    count = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes))).alias("start"))
    # A given number of parts: the rows are too small for Spark to see the work behind them.
    ranges = ranges.repartition(int(min(count, most_tasks)), F.xxhash64("path", "start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("warc_file", pa.string()), ("warc_offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner = _file_system(path)
                with system.open_input_file(inner) as file:
                    rows, size = [], 0
                    for at, content in records(_Bytes(file, start), start, start + split_bytes):
                        rows.append({"warc_file": path, "warc_offset": at} | parse(content))
                        size += len(content)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(read, RECORD)


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""


@query("op2_warc_round_trip", OP2_SQL)
def op2_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    archive = new_folder(spark, "warc")
    write_warc(table(spark, folder, "pages"), archive)
    got = read_warc(spark, archive)
    full = F.col("record_type") == "response"

    def page(uri):
        return F.nullif(F.regexp_extract(uri, "<urn:page:(.*)>", 1), F.lit("")).cast("bigint")

    return got.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(full, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type", page(F.col("refers_to")).alias("refers_to"))
