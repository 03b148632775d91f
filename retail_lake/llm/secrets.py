"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new.

A candidate is a long run of token characters shortly after a word that speaks of secrets, be
it before the run, in the name of ``NAME=value`` or before segments that dots join to it.  It
is compressed between its surroundings by zstandard, primed with a dictionary of identifiers;
the bytes it adds to the compressed surroundings are its novelty.  Names, paths and repeated
values add few bytes, random strings nearly their information content.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.common import rows

# The kinds in their order and the patterns that define them.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Parts of a candidate between equals signs; those at its end are padding.
VALUE = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:=+\Z)?")
#: Candidates with what dots join to them.
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
SENSITIVE = (b"key", b"secret", b"token", b"passw", b"pwd", b"auth", b"credential", b"bearer", b"private", b"signature")
#: Characters before a candidate in which a sensitive word must stand.
REACH = 48
#: Characters of surrounding text on either side.
AROUND = 256
#: Least added bytes per character.
NOVELTY = 0.65
IDENTIFIERS = (
    "access account address application argument array attribute authorization backend bearer boolean bucket buffer "
    "callback certificate character class client cluster column command comment config configuration connection const "
    "constructor container content context cookie create credential database dataset default delete description "
    "destination directory document download element encoding endpoint environment example exception export extends "
    "false filename filter final float format frontend function generate handler header hostname identifier implements "
    "import index initialize input insert instance integer interface internal iterator javascript keyword language length "
    "library license listener localhost location logger manager message metadata method model module namespace network "
    "number object option output package parameter parent password pattern payload permission placeholder platform "
    "private production property protected provider public query queue readonly record reference region register request "
    "resource response result return runtime schema secret security select sequence server service session setting "
    "signature source standard static status storage string struct target template thread timeout timestamp token "
    "transaction transform true undefined update upload username validate value variable version virtual webhook "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 http https www com org net"
)

Span = tuple[str, int, int]


def base_spans(text: str, lowered: bytes) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind; ``lowered``: its UTF-8 in lower case."""
    found: list[Span] = []
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"akia" in lowered:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered(spans))


def speaks(text: str) -> bool:
    """Whether a text holds a word that speaks of secrets."""
    lowered = text.lower().encode()
    return any(w in lowered for w in SENSITIVE)


def name_of(text: str, run: int, start: int) -> str:
    """The name before the last equals sign between the beginning of a run and a value in it."""
    at = text.rfind("=", run, start)
    return text[max(run, text.rfind("=", run, at) + 1) : at] if at >= 0 else ""


class Novelty:
    def __init__(self, identifiers: str):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)

    def added(self, text: str, start: int, end: int) -> int:
        """Bytes that ``text[start:end]`` adds to its compressed surroundings."""
        before, after = text[max(0, start - AROUND) : start].encode(), text[end : end + AROUND].encode()
        middle = text[start:end].encode()
        return len(self.compressor.compress(before + middle + after)) - len(self.compressor.compress(before + after))

    def spans(self, text: str, taken: list[Span], least: float) -> list[Span]:
        found = []
        for run in RUN.finditer(text):
            told = speaks(text[max(0, run.start() - REACH) : run.start()])
            for m in CANDIDATE.finditer(text, *run.span()):
                # no part is long enough: the candidate as it stands
                values = [v.span() for v in VALUE.finditer(text, *m.span())] or [m.span()]
                for start, end in values:
                    if any(s < end and start < e for _, s, e in taken):
                        continue
                    if told or speaks(text[max(0, start - REACH) : start]) or speaks(name_of(text, run.start(), start)):
                        if self.added(text, start, end) >= least * (end - start):
                            found.append(("novel", start, end))
        return found


def secret_scan(docs: DataFrame, identifiers: str = IDENTIFIERS, novelty: float = NOVELTY) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel`` of every document (null text: empty).

    ``spans`` lists kind:start:end in code points, end exclusive, by start and then kind;
    ``base_sha256`` is the digest of that list without the novel ones.  Novel strings never
    overlap a base span.  One row per input row; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Novelty(identifiers)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                lowered = text.encode().lower()
                base = base_spans(text, lowered)
                novel = judge.spans(text, base, novelty) if any(w in lowered for w in SENSITIVE) else []
                count = [sum(s[0] == kind for s in base) for kind in KINDS[:3]]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((*count, digest, joined(base + novel), len(novel)))
            columns = [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in names[1:]]
            yield rows(schema, [batch.column("doc_id"), *columns])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    )
