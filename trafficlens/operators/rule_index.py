"""Many signatures at one cost per payload: an index from literals that a pattern requires to the pattern.

Every match of most patterns contains a fixed text. The index holds a hash of that text per pattern; tasks parse the patterns,
and nothing that grows with them passes the driver. Of a payload the places where such a text may begin, and those where a whole one may
stand, are found in a bit array of bounded size; what is left is joined with the index, and only patterns whose text occurs are run. The cost
of a payload follows its length and its true candidates, not the number of signatures.
"""

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions import payload as P
from trafficlens.functions.payload import java_regex
from trafficlens.session import new_folder

# What runs on executors travels by value.
for module in (sys.modules[__name__], P):
    cloudpickle.register_pickle_by_value(module)

GRAM = 4
# An index that takes at most so many bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 128  # of a broadcast row beside its texts
# The bit array: bits per literal, and bits at most; a fuller array only lets more places through to the join.
LITERAL_BITS, MOST_BITS = 32, 1 << 28
PAGE_BITS = 1 << 20
PIECE_BYTES = 1 << 20  # of texts hashed at once

ROWS = "name string, regex string, literal string, earlier array<string>, length int, start long, hash long"


# Patterns of literals, escaped punctuation, dots, anchors, plain classes and alternatives need no parser.
_PARTS = r"(?:[^\\\[\](){}.*+?^$|\x80-\U0010ffff]|\\[!-/:-@\[-`{-~])+|\.|[\^$]|\[[^\\\[\]^&~|-][^\\\[\]&~|-]+\]|\|"
_SIMPLE, _PART, _ESCAPE = re.compile(f"(?:{_PARTS})+"), re.compile(_PARTS), re.compile(r"\\(.)")


def _simple_literals(pattern: str) -> tuple[str, ...] | None:
    """What :func:`required_literals` finds in most simple patterns; None asks for the parser."""
    if not _SIMPLE.fullmatch(pattern):
        return None
    branches = [[""]]
    for part in _PART.findall(pattern):
        if part == "|":
            branches.append([""])
        elif part == "." or part[0] == "[":
            branches[-1].append("")
        elif part not in "^$":
            branches[-1][-1] += _ESCAPE.sub(r"\1", part).lower()
    found = [max(runs, key=len) for runs in branches]
    # The parser takes out what alternatives begin with in common.
    alike = len(branches) > 1 and len({runs[0][:1] for runs in branches}) < len(branches)
    return None if alike or min(map(len, found)) < GRAM else tuple(dict.fromkeys(found))


def required_literals(pattern: str) -> tuple[str, ...] | None:
    """Lower-case ASCII texts of which every match contains at least one, in any case; None where there is no such set.

    Of a sequence the element with the longest shortest text counts; alternatives need one text each.
    """
    try:
        return _simple_literals(pattern) or _required(_parser.parse(pattern.encode()))
    except (re.error, RecursionError, OverflowError):
        return None


def _required(tree) -> tuple[str, ...] | None:
    found: list[tuple[str, ...]] = []
    run: list[str] = []

    def close() -> None:
        if run:
            found.append(("".join(run).lower(),))
            run.clear()

    for op, value in tree:
        if op is C.LITERAL and value < 128:
            run.append(chr(value))
            continue
        if op is C.AT:
            continue
        close()
        inner = None
        if op is C.SUBPATTERN:
            inner = _required(value[3])
        elif op is C.ATOMIC_GROUP:
            inner = _required(value)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _required(value[2])
        elif op is C.BRANCH:
            parts = [_required(branch) for branch in value[1]]
            inner = tuple(dict.fromkeys(x for p in parts for x in p)) if all(parts) else None
        if inner:
            found.append(inner)
    close()
    return max(found, key=lambda texts: (min(map(len, texts)), -len(texts)), default=None)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def windows(data: bytes, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of all windows of each of ``sizes``, powers of two: those of twice the size come from two of half of it."""
    h, size = np.frombuffer(data, np.uint8).astype(np.uint64), 1
    while size <= max(sizes, default=0) and len(h):
        if size in sizes:
            yield size, h
        h = mixed(h[: max(len(h) - size, 0)], h[size:])
        size *= 2


def start_of(window: np.ndarray, size: int) -> np.ndarray:
    return mixed(window, np.uint64(size))


def whole_of(first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Hash of a text from its first and its last window, which cover it."""
    return mixed(mixed(first, last), np.uint64(length))


def window_size(length: int) -> int:
    """The largest power of two that is no larger."""
    return 1 << (length.bit_length() - 1)


def pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Runs of texts of bounded size: number of the first one, texts, and where each ends in all of them."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= PIECE_BYTES or k + 1 == len(texts):
            own = texts[first : k + 1]
            yield first, own, np.cumsum([len(x) for x in own])
            first, size = k + 1, 0


def hashed(literals: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first window and of the whole of each literal."""
    start, whole = np.zeros(len(literals), np.uint64), np.zeros(len(literals), np.uint64)
    for first, own, ends in pieces(literals):
        length = np.diff(ends, prepend=0)
        size = np.array([window_size(n) for n in length.tolist()])
        for s, h in windows(b"".join(own), set(size.tolist())):
            mine = np.flatnonzero(size == s)
            begin, end = ends[mine] - length[mine], ends[mine]
            start[first + mine] = start_of(h[begin], s)
            whole[first + mine] = whole_of(h[begin], h[end - s], length[mine].astype(np.uint64))
    return start, whole


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per pattern and text of which it requires one, or a row without text."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.int64()]
    names = ["name", "regex", "literal", "earlier", "length", "start", "hash"]
    for batch in batches:
        rows = []
        for name, pattern in zip(batch.column("name").to_pylist(), batch.column("pattern").to_pylist()):
            regex, needed = java_regex(pattern), required_literals(pattern)
            if needed and min(map(len, needed)) >= GRAM:
                rows += [(name, regex, x, list(needed[:k]), len(x)) for k, x in enumerate(needed)]
            else:
                rows.append((name, regex, None, None, None))
        start, whole = hashed([(r[2] or "\0").encode() for r in rows])
        columns = [*zip(*rows), start.view(np.int64), whole.view(np.int64)] if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


@dataclass
class RuleIndex:
    """``rows``: name, regex, literal, ``earlier`` (the pattern's literals before it) and the literal's hash; ``bits``: the bit array; ``lengths`` of the literals."""

    rows: DataFrame
    bits: Broadcast
    lengths: list[int]


def build(rules: DataFrame) -> tuple[RuleIndex | None, DataFrame]:
    """(index, rest) of rows (name, pattern); ``rest`` has name and regex of the patterns without a literal of ``GRAM`` bytes."""
    spark, path = rules.sparkSession, new_folder(rules.sparkSession, "rules")
    rules.select("name", "pattern").mapInArrow(parsed, ROWS).write.parquet(path)
    rows = spark.read.schema(ROWS).parquet(path)
    rest, rows = rows.filter("literal is null").select("name", "regex"), rows.filter("literal is not null")
    texts = F.length("name") + F.length("regex") + F.length("literal") + F.aggregate("earlier", F.lit(0), lambda n, x: n + F.length(x))
    size, n, lengths = rows.agg(F.sum(texts + ROW_BYTES), F.count(F.lit(1)), F.collect_set("length")).first()
    if not n:
        return None, rest
    n_bits = min(max(1 << (LITERAL_BITS * n - 1).bit_length(), 1 << 16), MOST_BITS)

    def paged(group: pd.DataFrame) -> pd.DataFrame:
        page = np.zeros(min(n_bits, PAGE_BITS), bool)
        page[group["bit"].to_numpy() % PAGE_BITS] = True
        return pd.DataFrame({"page": group["page"].iloc[:1], "bits": [np.packbits(page, bitorder="little").tobytes()]})

    key = F.explode(F.array("start", "hash")).alias("key")
    both = F.array(*[F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(n_bits - 1)) for shift in (0, 32)])
    bit = rows.select(key).distinct().select(F.explode(both).alias("bit")).distinct()
    pages = bit.withColumn("page", F.floor(F.col("bit") / PAGE_BITS)).groupBy("page").applyInPandas(paged, "page long, bits binary").collect()
    bits = np.zeros(n_bits >> 3, np.uint8)
    for page, own in pages:
        at = page * (PAGE_BITS >> 3)
        bits[at : at + len(own)] = np.frombuffer(own, np.uint8)
    index = rows.select("name", "regex", "literal", "earlier", "hash")
    return RuleIndex(F.broadcast(index) if size <= BROADCAST_BYTES else index, spark.sparkContext.broadcast(bits), sorted(lengths)), rest


def occurring(index: RuleIndex):
    """Function of byte texts in lower case: distinct hashes of the index's literals, and of few others, that occur in each."""
    shared, lengths = index.bits, {}
    for n in index.lengths:
        lengths.setdefault(window_size(n), []).append(n)

    @F.pandas_udf("array<long>")
    def found(texts: pd.Series) -> pd.Series:
        bits = shared.value
        mask, eighth, low = np.uint64(len(bits) * 8 - 1), np.uint64(3), np.uint64(7)

        def marked(keys: np.ndarray) -> np.ndarray:
            out = np.ones(len(keys), bool)
            for shift in (0, 32):
                bit = (keys >> np.uint64(shift)) & mask
                out &= (bits[bit >> eighth] >> (bit & low).astype(np.uint8)) & 1 > 0
            return out

        out = [np.empty(0, np.int64)] * len(texts)
        for first, own, ends in pieces([t or b"" for t in texts]):
            rows, keys = [], []
            for size, h in windows(b"".join(own), set(lengths)):
                at = np.flatnonzero(marked(start_of(h, size)))
                row = np.searchsorted(ends, at, "right")
                left = ends[row] - at
                for n in lengths[size]:
                    fits = left >= n
                    begin = at[fits]
                    key = whole_of(h[begin], h[begin + n - size], n)
                    hit = marked(key)
                    rows.append(row[fits][hit])
                    keys.append(key[hit])
            if not rows:
                continue
            rows, keys = np.concatenate(rows), np.concatenate(keys).view(np.int64)
            order = np.lexsort((keys, rows))
            rows, keys = rows[order], keys[order]
            new = np.r_[True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])][: len(rows)]
            rows, keys = rows[new], keys[new]
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            for r, part in zip(rows[starts].tolist(), np.split(keys, starts[1:]) if len(starts) else []):
                out[first + r] = part
        return pd.Series(out)

    return found


def hits(df: DataFrame, index: RuleIndex, key: str, text: Column) -> DataFrame:
    """(key, signature) of the indexed patterns that match ``text`` (a byte text); each pattern once per row.

    A candidate counts only for the first of its literals that occurs.
    """
    texts = df.select(F.col(key).alias("_key"), text.alias("_text")).filter(F.length("_text") >= GRAM)
    probed = texts.withColumn("_hash", F.explode(occurring(index)(F.encode(F.lower("_text"), "ISO-8859-1"))))
    lower = F.lower("_text")
    candidate = F.contains(lower, F.col("literal")) & ~F.exists("earlier", lambda x: F.contains(lower, x))
    found = probed.join(index.rows, F.col("_hash") == F.col("hash")).filter(candidate).filter(F.rlike("_text", F.col("regex")))
    return found.select(F.col("_key").alias(key), F.col("name").alias("signature"))
