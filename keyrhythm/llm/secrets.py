"""Secret scan: fixed patterns, and strings in sensitive places that zstandard finds nothing to say about.

A candidate is a long unbroken string on a line after a sensitive word. It is compressed behind the
code around it, by a compressor primed with a dictionary of common identifiers; the bytes that it
adds, in relation to its length, are its novelty. Names, paths and prose repeat what the dictionary
or the surroundings hold and add little; keys, tokens and passwords add nearly all their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from keyrhythm.llm.registry import query, table

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns. Runs shorter than asked fail as a whole, so the length can stand in
#: the pattern where a run is always matched to its end.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that make what follows on the line sensitive.
SENSITIVE = re.compile(r"passw(?:or)?d|pwd|secret|token|api.?key|access.?key|credential|auth|bearer|private|signature", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

#: Identifiers and placeholders that are no secrets, however they are written together.
IDENTIFIERS = """
abstract access account action active address admin after algorithm amount api application apply argument array assert async attribute
auth authentication author authorization available await base64 before begin binary boolean branch browser buffer build builder button bytes cache
callback cancel category certificate changeme channel character check child class clear client close cluster code collection color column
command comment commit common component config configuration connect connection console const constant constructor container content
context continue control controller convert cookie copy count create created credential current custom database dataset date debug
decode default define delete deploy description destination device dictionary digest directory disabled display document domain download
dummy duration dynamic element email enabled encode encoding encrypt endpoint engine entity environment error event example exception
execute expected export expression extension factory false field file filter final finish float folder footer format forward frame
function generate global graph group handler hash header height history host http https hidden identifier image import index info
initialize input insert instance integer interface internal invalid item iterator java javascript json kernel label language layout
length level library license limit line link list listener loader local localhost location logger login logout manager mapping markdown
master match maximum member memory message metadata method middleware minimum missing mobile model module monitor mutable name namespace
navigation network next node none normal notification null number object offset operation option order output package page parameter
parent parse parser partition password path pattern payload permission pipeline placeholder platform plugin pointer policy position
prefix previous primary print private process processor production profile progress project property protected protocol provider proxy
public publish python query queue random range read reader record redirect reference refresh register release remote remove render
repository request required reset resource response result return role root route router sample schedule schema scope script search
secret section security select selector sensitive sequence serializer server service session setting setup shared signature simple
single size source stack start state static status storage store stream string struct style submit subscribe success suffix summary
support switch symbol system table target task template test text thread threshold timeout timestamp title token tools total trace
transaction transform tree trigger true type undefined unique unknown update upload user username utils valid validate value variable
vector verify version view virtual visible warning width window worker wrapper write writer xxxxxxxx your_api_key_here your-secret-here
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000000000000000 2020 2021 2022 2023 2024 2025
""".strip().replace("\n", " ")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches that are long enough."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Novelty:
    """Marginal compressed size of a string, given what stands around it and a dictionary."""

    def __init__(self, identifiers: str = IDENTIFIERS, around: int = 256):
        primed = zstandard.ZstdCompressionDict(identifiers.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters(compression_level=19, window_log=17, write_content_size=False, write_checksum=False,
                                                       write_dict_id=False, min_match=3)
        self.compress = zstandard.ZstdCompressor(dict_data=primed, compression_params=settings).compress
        self.around = around

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes that the string adds behind its surroundings, for each of its bytes; letters in lower case."""
        context = (text[max(0, start - self.around) : start] + " " + text[end : end + self.around] + " ").lower().encode()
        string = text[start:end].lower().encode()
        return (len(self.compress(context + string)) - len(self.compress(context))) / len(string)


def novel_spans(text: str, novelty: Novelty, least: float, reach: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) of incompressible strings within ``reach`` characters after a sensitive word of their line."""
    found: dict[int, int] = {}
    for word in SENSITIVE.finditer(text):
        at = word.end()
        line_end = text.find("\n", at)
        line_end = len(text) if line_end < 0 else line_end
        for m in CANDIDATE.finditer(text, at, line_end):
            if m.start() > at + reach:
                break
            if m.start() not in found and novelty.of(text, m.start(), m.end()) >= least:
                found[m.start()] = m.end()
    return [(start, 3, end) for start, end in found.items()]


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


RESULT = ("n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string, "
          "findings array<struct<kind:string,start:int,end:int,value:string>>")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.85, reach: int = 40, around: int = 256) -> DataFrame:
    """``doc_id``, counts by kind, digest of the base spans, all spans, and the findings themselves.

    Spans are code points, the end excluded, in order of their start and then of ``KINDS``. A NULL or
    empty text has none. Repeated rows are scanned one by one; a NULL id stays NULL. An empty table
    gives an empty one; other columns are left out. Rows do not depend on each other, so one long
    text is the most that a task holds beside a batch.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(around=around)
        finding = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                content = value.as_py() or ""
                base = base_spans(content)
                spans = sorted(base + novel_spans(content, novelty, least, reach))
                counts = [sum(s[1] == k for s in spans) for k in range(4)]
                rows = [{"kind": KINDS[k], "start": s, "end": e, "value": content[s:e]} for s, k, e in spans]
                for column, cell in zip(out, (*counts, hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans), rows)):
                    column.append(cell)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(finding)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                                             names=["_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "findings"])

    return docs.select(doc_id, text).mapInArrow(scan, f"_id {kind}, {RESULT}").withColumnRenamed("_id", doc_id)


@query("op3_secret_novelty")
def op3_secret_novelty(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents")).drop("findings")
