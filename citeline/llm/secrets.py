"""Secrets in whole texts: keyword prefilter, anchored patterns at its hits, checksums.

One Aho-Corasick automaton runs over the text's bytes with A-Z lower-cased and reports where a keyword of any kind begins. Only there
the kind's pattern is tried, anchored at the hit; every pattern begins with one of its keywords, so no match is missed. Hits inside the
kind's last match are passed over, whether that match was long enough or not, which gives the leftmost non-overlapping matches of a
scan of the whole text. Runs of hex digits have no keyword in the text, but one in the text's classes (32 times "digit"); a search
for a single keyword is a substring search, and the pattern is anchored at the start of the run.

Kinds `github` and `npm` are added to the three base kinds: a known prefix, 30 characters and, as six digits of base 62, the CRC-32 of
these 30. Only tokens whose checksum holds are reported. Base spans stay whatever the added kinds find; a span may overlap one of another kind.

All patterns are ASCII, so they are matched on UTF-8 bytes; places are turned into code points for the spans found only. Every row of the
table gives one row, read where it lies, without a shuffle: null and empty texts have no spans and the digest of an empty string;
repeated rows and null identifiers stay as they are; an empty table gives no row; columns besides the identifier and the text are not
read. A text is one cell; work is linear in its bytes.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from citeline.llm.common import documents
from citeline.session import spread

ASSIGN, ACCESS, HEX, GITHUB, NPM = KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3
KEYWORDS = {
    ASSIGN: ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ACCESS: ("akia",),
    GITHUB: ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    NPM: ("npm_",),
}
PATTERNS = {
    ASSIGN: re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ACCESS: re.compile(rb"AKIA[A-Z0-9]+"),
    HEX: re.compile(rb"[0-9a-f]+"),
    GITHUB: re.compile(rb"gh[pousr]_[0-9A-Za-z]+"),
    NPM: re.compile(rb"npm_[0-9A-Za-z]+"),
}
ASSIGNED, ACCESS_SIZE, HEX_SIZE, TOKEN_SIZE, CHECK_SIZE = 8, 16, 32, 40, 6
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_CLASSES = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
_RUN = b"\1" * HEX_SIZE


def checksum_holds(token: bytes) -> bool:
    """Whether the last six characters of a token are the CRC-32 of the 30 between them and its prefix of four."""
    if len(token) != TOKEN_SIZE:
        return False
    value = 0
    for c in token[-CHECK_SIZE:]:
        value = value * 62 + DIGITS.index(c)
    return value == zlib.crc32(token[4:-CHECK_SIZE])


ACCEPTS = {
    ASSIGN: lambda m: len(m.group(2)) >= ASSIGNED,
    ACCESS: lambda m: m.end() - m.start() >= ACCESS_SIZE,
    GITHUB: lambda m: checksum_holds(m.group()),
    NPM: lambda m: checksum_holds(m.group()),
}


@lru_cache(maxsize=1)
def _automaton():
    """Keyword -> (kind, size of the keyword); built once a worker."""
    made = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def _hex_spans(raw: bytes):
    classes, at = raw.translate(_CLASSES), 0
    while (at := classes.find(_RUN, at)) >= 0:
        end = PATTERNS[HEX].match(raw, at).end()
        yield at, end
        at = end


def find(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every span of a UTF-8 text, in bytes, in order."""
    ends, found = dict.fromkeys(KEYWORDS, 0), []
    for last, (kind, size) in _automaton().iter(raw.lower().decode("latin-1")):
        start = last + 1 - size
        if start < ends[kind]:
            continue
        match = PATTERNS[kind].match(raw, start)
        if match is not None:
            ends[kind] = match.end()
            if ACCEPTS[kind](match):
                found.append((start, KINDS.index(kind), match.end()))
    number = KINDS.index(HEX)
    found += [(start, number, end) for start, end in _hex_spans(raw)]
    return sorted(found)


def in_code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with places counted in code points; one pass over the bytes up to the last span."""
    if raw.isascii():
        return spans
    place, at, points = {}, 0, 0
    for byte in sorted({p for start, _, end in spans for p in (start, end)}):
        points += len(raw[at:byte].decode())
        at, place[byte] = byte, points
    return [(place[start], kind, place[end]) for start, kind, end in spans]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(batches):
    for batch in batches:
        rows = []
        for raw in batch.column("text").cast(pa.large_binary()).to_pylist():
            spans = in_code_points(raw or b"", find(raw or b""))
            kinds = [kind for _, kind, _ in spans]
            base = _joined([s for s in spans if s[1] < BASE])
            rows.append((*map(kinds.count, range(BASE)), hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
        columns = list(zip(*rows)) or [[]] * (BASE + 2)
        types = [*[pa.int64()] * BASE, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
            names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, the number of spans of each base kind, the digest of the base spans, and all spans."""
    kind = docs.schema[key].dataType.simpleString()
    rows = spread(docs.selectExpr(f"`{key}` AS id", f"CAST(`{text}` AS string) AS text"))
    found = rows.mapInArrow(_scan, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.withColumnRenamed("id", key)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``."""
    return scan(documents(spark, sf_dir))


# A kind's matches and the pieces between them, both in order, give its places by running sums.
SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS tab),
kinds(kind, number, pattern) AS (VALUES
  ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]{32,}'), ('github', 3, 'gh[pousr]_[0-9A-Za-z]+'), ('npm', 4, 'npm_[0-9A-Za-z]+')),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, kind, number, text, regexp_extract_all(text, pattern) AS found, regexp_split_to_array(text, pattern) AS between
      FROM d, kinds WHERE regexp_matches(text, pattern)),
e AS (SELECT r, kind, number, unnest(found) AS hit, unnest(between[:len(found)]) AS gap, unnest(range(len(found))) AS n FROM m),
p AS (SELECT r, kind, number, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY n) AS stop FROM e),
c AS (SELECT *, CASE WHEN number > 2 AND length(hit) = 40 THEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(hit[5:34], ''), lambda s: ord(s)::BIGINT)),
        lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) END AS sum,
      list_reduce(list_prepend(0::BIGINT, list_transform(string_split(hit[35:40], ''),
        lambda s: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', s) - 1)::BIGINT)), lambda x, y: x * 62 + y) AS told FROM p, crc),
s AS (SELECT r, kind, number, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop FROM c WHERE CASE number
      WHEN 0 THEN length(regexp_extract(hit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8 WHEN 1 THEN length(hit) >= 16
      WHEN 2 THEN length(hit) >= 32 ELSE length(hit) = 40 AND sum = told END),
g AS (SELECT r, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER (number < 3) AS base,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""
QUERIES = {"op13_secret_scan": (op13_secret_scan, SQL)}
