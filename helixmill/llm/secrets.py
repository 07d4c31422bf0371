"""Secrets in texts: keyword automaton, anchored expressions, checksums.

An Aho-Corasick automaton finds the keywords of all kinds in one pass over the
lower-cased text.  Only where one ends is its kind's expression tried, anchored
at the keyword.  Hexadecimal runs have no keyword; their prefilter is the run
itself.  Token formats that carry a checksum are added to the base kinds only
if the checksum agrees.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import slices

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = 3
#: The base kinds' expressions and lengths.
_KEY = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_ASSIGN_LENGTH, _ACCESS_LENGTH = 12, 18
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "api_key", "apikey"), 0),
    "akia": 1,
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), 3),
    "npm_": 4,
}

Span = tuple[int, int, int]  # start, kind, end


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word) - 1))
    found.make_automaton()
    return found


def checksum_agrees(body: str, check: str) -> bool:
    """Whether `check` is the CRC-32 of `body` in six base-62 digits."""
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = _DIGITS[d] + digits
    return digits.rjust(6, "0") == check


def spans_of(text: str, automaton: ahocorasick.Automaton) -> list[Span]:
    """All spans of a text in code points, by start, then kind.

    Matches of a kind don't overlap, the leftmost wins; one that is too short
    is dropped but still covers its characters.
    """
    found: list[Span] = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits: dict[int, list[int]] = {}
    for end, (kind, back) in automaton.iter(lower):
        hits.setdefault(kind, []).append(end - back)
    for kind, starts in hits.items():
        over = 0
        for at in sorted(starts):
            if at < over:
                continue
            if kind == 0:
                if m := _ASSIGN.match(text, at):
                    over = m.end()
                    if len(m[2]) >= _ASSIGN_LENGTH:
                        found.append((at, kind, over))
            elif kind == 1:
                if m := _ACCESS.match(text, at):
                    over = m.end()
                    if over - at >= _ACCESS_LENGTH:
                        found.append((at, kind, over))
            elif (m := (_GITHUB if kind == 3 else _NPM).match(text, at)) and checksum_agrees(m[1], m[2]):
                over = m.end()
                found.append((at, kind, over))
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans as [<first kind>]."""
    out, at, upto = [], 0, 0
    for start, kind, end in spans:
        if start >= upto:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = upto = max(upto, end)
    return "".join([*out, text[at:]])


_RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """docs with the span columns; with `redact`, the text has its spans replaced.

    A null text has no spans and stays null.  Columns of these names are
    replaced, others pass through; rows are judged one by one.
    """
    names = [c.split()[0] for c in _RESULT.split(", ")]
    docs = docs.drop(*names)
    schema = docs.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _RESULT.split(", "))).schema
    for f in schema:
        f.nullable = True

    def scan(batches):
        automaton = _automaton()
        for s in slices(batches, text):
            at = s.batch.schema.get_field_index(text)
            texts = s.batch.column(at).to_pylist()
            rows = [spans_of(t, automaton) if t else [] for t in texts]
            base = [[x for x in r if x[1] < BASE_KINDS] for r in rows]
            columns = s.batch.columns
            if redact:
                columns[at] = pa.array([redacted(t, r) if r else t for t, r in zip(texts, rows)], columns[at].type)
            columns += [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in range(BASE_KINDS)]
            columns += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()), pa.array([joined(r) for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*s.batch.schema.names, *names])

    return docs.mapInArrow(scan, schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their spans; see find() for nulls, empty texts, ties and repeated rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs).drop("text")
