"""Secret scan: keyword automaton, anchored patterns near its hits, checksum validation.

One Aho-Corasick automaton holds the keywords of all detectors and reads each text once.  A detector's regular
expression is tried only where its keyword was hit; detectors whose secrets carry a checksum recompute it.
Runs of hexadecimal digits have no keyword; one linear pass over the bytes finds them.

Null text counts as empty and gives zero counts and empty strings.  Rows are independent: repeated rows give repeated
results.  Only the id and text columns are read, so other columns and their names don't matter.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in output order, and the least lengths of the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "age", "nsec")
MIN_ASSIGN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{%d,}" % MIN_HEX)
_GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_AGE = re.compile(rb"AGE-SECRET-KEY-1([QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58})(?![A-Z0-9])")
_NSEC = re.compile(rb"nsec1([qpzry9x8gf2tvdw0s3jn54khce6mua7l]{58})(?![a-z0-9])")


def base62_crc32(body: bytes) -> bytes:
    """The six base-62 digits of the CRC-32 of ``body``, as tokens of code hosts end with."""
    n, digits = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        digits = BASE62[r] + digits
    return digits.encode()


def bech32_valid(prefix: str, data: str) -> bool:
    """Whether ``prefix`` + "1" + ``data`` carries a right bech32 checksum."""
    check = 1
    for v in [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(BECH32_STEPS):
            if top >> i & 1:
                check ^= step
    return check == 1


def _crc_ok(m: re.Match) -> bool:
    return base62_crc32(m[1]) == m[2]


#: keyword in lower case -> (kind, pattern, check of a match that must hold)
_DETECTORS = {
    **{k: ("assign", _ASSIGN, lambda m: len(m[2]) >= MIN_ASSIGN_VALUE) for k in ASSIGN_KEYWORDS},
    "akia": ("access", _ACCESS, lambda m: len(m[0]) >= MIN_ACCESS),
    **{k: ("github", _GITHUB, _crc_ok) for k in GITHUB_PREFIXES},
    "npm_": ("npm", _NPM, _crc_ok),
    "age-secret-key-1": ("age", _AGE, lambda m: bech32_valid("age-secret-key-", m[1].decode().lower())),
    "nsec1": ("nsec", _NSEC, lambda m: bech32_valid("nsec", m[1].decode())),
}


@dataclass(frozen=True)
class Span:
    start: int
    kind: int
    end: int


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, (kind, _, _) in _DETECTORS.items():
        a.add_word(word, (word, len(word), kind))
    a.make_automaton()
    return a


def find_spans(text: str | None, automaton) -> list[Span]:
    """All spans in code points, by start, then kind."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, int]] = [(m.start(), 2, m.end()) for m in _HEX.finditer(data)]
    after = [0] * len(KINDS)  # a kind's next match starts here at the earliest
    hits = sorted((end - n + 1, word) for end, (word, n, _) in automaton.iter(data.lower().decode("latin-1")))
    for start, word in hits:
        kind, pattern, holds = _DETECTORS[word]
        k = KINDS.index(kind)
        if start >= after[k] and (m := pattern.match(data, start)):
            after[k] = m.end()
            if holds(m):
                found.append((start, k, m.end()))
    if found and not data.isascii():
        lead = np.zeros(len(data) + 1, np.int64)  # code points that begin before each byte
        np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=lead[1:])
        found = [(int(lead[s]), k, int(lead[e])) for s, k, e in found]
    return [Span(s, k, e) for s, k, e in sorted(found)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    run: Span | None = None
    for s in spans:
        if run and s.start < run.end:
            run = Span(run.start, run.kind, max(run.end, s.end))
            continue
        if run:
            out += [text[at : run.start], f"[{KINDS[run.kind]}]"]
            at = run.end
        run = s
    if run:
        out += [text[at : run.start], f"[{KINDS[run.kind]}]"]
        at = run.end
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts by base kind, digest of the base spans, all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                spans = find_spans(text.as_py(), automaton)
                base = [s for s in spans if s.kind < 3]
                n = [sum(s.kind == k for s in base) for k in range(3)]
                rows.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, SCHEMA)


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with every secret in ``text_col`` replaced by its kind in brackets.

    ``chars_col`` (if given and present) is set to the new length in changed rows.  Null texts stay null.
    """
    place = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            columns = list(b.columns)
            texts, lengths, changed = [], [], False
            old = columns[chars].to_pylist() if chars is not None else [None] * b.num_rows
            for value, n in zip(columns[place], old):
                text = value.as_py()
                spans = find_spans(text, automaton)
                if spans:
                    text = redacted(text, spans)
                    n, changed = len(text), True
                texts.append(text)
                lengths.append(n)
            if changed:
                columns[place] = pa.array(texts, columns[place].type)
                if chars is not None:
                    columns[chars] = pa.array(lengths, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(clean, docs.schema)
