"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns only at hits, then embedded checksums."""

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which spans of one start are listed; the first three carry no checksum.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "xprv": "xprv",
}
PATTERNS = {
    "assign": re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII),
    "access": re.compile(r"(AKIA[A-Z0-9]+)"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    "xprv": re.compile(r"(xprv[1-9A-HJ-NP-Za-km-z]{107})(?![1-9A-HJ-NP-Za-km-z])"),
}
LEAST = {"assign": 8, "access": 16}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_suffix(body: str) -> bool:
    """30 characters followed by their CRC-32 in six base-62 digits."""
    value, digits = zlib.crc32(body[:30].encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits == body[30:]


def base58_check(body: str) -> bool:
    """Base-58 number whose last four bytes begin the double SHA-256 of the others."""
    value = 0
    for c in body:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return len(raw) == 82 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def valid(kind: str, body: str) -> bool:
    if kind in LEAST:
        return len(body) >= LEAST[kind]
    return base58_check(body) if kind == "xprv" else crc_suffix(body)


def spans_of(text: str, automaton) -> list[tuple[str, int, int]]:
    """All (kind, start, end) in code points, by start, then kind as listed; leftmost and non-overlapping per kind."""
    found = [("hex", m.start(), m.end()) for m in PATTERNS["hex"].finditer(text)]
    lowered = text.encode().lower().decode()
    hits: dict[str, set[int]] = {}
    for end, (kind, length) in automaton.iter(lowered):
        hits.setdefault(kind, set()).add(end - length + 1)
    for kind, starts in hits.items():
        free = 0
        for start in sorted(starts):
            # A match that fails its test still covers its text, as in a plain left-to-right search.
            if start >= free and (m := PATTERNS[kind].match(text, start)):
                free = m.end()
                if valid(kind, m.group(1)):
                    found.append((kind, start, free))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def keyword_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``spans``: array of (kind, start, end) in code points, end exclusive.

    Every row is scanned whole and on its own; null and empty texts have no spans, an empty table gives an empty one.
    Columns that are neither ``keep`` nor ``text`` are not read.
    """
    taken = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scanned(batches):
        automaton = keyword_automaton()
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end"), s)) for s in spans_of(t.as_py(), automaton)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(rows, kind)], ["kept", "spans"])

    schema = taken.select("kept", F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("spans")).schema
    return taken.mapInArrow(scanned, schema).select("kept.*", "spans")


def spans_text(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
