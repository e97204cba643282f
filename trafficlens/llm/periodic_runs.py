"""Periodic run detection: suffix classes of a text's words, united by descending common prefix, seed the runs."""

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A run has at least so many words and so many whole periods.
LEAST, TIMES = 6, 4
PORTION = 2 << 20  # bytes of text whose suffixes are sorted together
CHUNK = 1024
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Positions:
    """Ordered set of positions in short sorted chunks, so that an insertion moves little however large the set is."""

    __slots__ = ("chunks", "heads", "size")

    def __init__(self, position: int):
        self.chunks, self.heads, self.size = [[position]], [position], 1

    def __iter__(self):
        return (p for c in self.chunks for p in c)

    def add(self, position: int) -> tuple[int, int]:
        """Insert; returns the neighbours before and after, -1 where there is none."""
        k = max(bisect_right(self.heads, position) - 1, 0)
        chunk = self.chunks[k]
        j = bisect_left(chunk, position)
        before = chunk[j - 1] if j else (self.chunks[k - 1][-1] if k else -1)
        after = chunk[j] if j < len(chunk) else (self.chunks[k + 1][0] if k + 1 < len(self.chunks) else -1)
        chunk.insert(j, position)
        self.size += 1
        if not j:
            self.heads[k] = position
        if len(chunk) > CHUNK:
            half = CHUNK // 2
            self.chunks.insert(k + 1, chunk[half:])
            self.heads.insert(k + 1, chunk[half])
            del chunk[half:]
        return before, after


def suffix_edges(word: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all texts in order, as far as they share ``least`` words with a neighbour in their own text.

    ``word``: number of the word at each place, ``text``: number of its text. Returns (left, right, common): neighbours in
    suffix order and the length of their common prefix. Ranks by 1, 2, 4 ... words are refined by doubling; places that
    are unique by some length take no further part, and all levels are kept to look the common prefixes up.
    """
    n = len(word)
    key = text * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, width, kept = [rank.astype(np.int32)], 1, order[:0]
    active = order[~(new & np.r_[new[1:], True])]  # in rank order
    while len(active):
        if width <= least:
            kept = active
        behind = active + width
        inside = behind < n
        inside[inside] = text[behind[inside]] == text[active[inside]]
        key = rank[active] * (n + 1)
        key[inside] += rank[behind[inside]] + 1
        ranked = np.argsort(key, kind="stable")
        active, key = active[ranked], key[ranked]
        own, at = key // (n + 1), np.arange(len(active))
        group, new = np.r_[True, own[1:] != own[:-1]], np.r_[True, key[1:] != key[:-1]]
        rank[active] = own + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank.astype(np.int32))
        active, width = active[~(new & np.r_[new[1:], True])], width * 2
    if width <= least:  # nothing is that long
        kept = kept[:0]
    order = kept[np.argsort(rank[kept])]
    left, right = order[:-1], order[1:]
    same = text[left] == text[right]
    left, right = left[same], right[same]
    common, a, b = np.zeros(len(left), np.int64), left.copy(), right.copy()
    for level in reversed(range(len(levels))):
        ok = (a < n) & (b < n)
        ok[ok] = levels[level][a[ok]] == levels[level][b[ok]]
        step = ok.astype(np.int64) << level
        common, a, b = common + step, a + step, b + step
    far = common >= least
    return left[far], right[far], common[far]


def find_runs(word: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, places counted through all texts.

    Kruskal by descending common prefix: an edge joins the classes of two neighbouring suffixes, the smaller position set
    goes into the larger, and positions that become neighbours there at a distance within the common prefix seed a run,
    counted where no word before continues it. Within a run the first position and the one a period later share all but
    one period of it, and no position between them belongs to their class, so every run is seeded.
    """
    shortest = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    left, right, common = suffix_edges(word, text, shortest)
    if not len(left):
        return []
    places, number = np.unique(np.r_[left, right], return_inverse=True)
    root, sets = list(range(len(places))), [Positions(p) for p in places.tolist()]
    order = np.argsort(-common, kind="stable")
    own, of = word.tolist(), text.tolist()
    seeds: dict[tuple[int, int], int] = {}
    for i, j, shared in zip(number[: len(left)][order].tolist(), number[len(left) :][order].tolist(), common[order].tolist()):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        if sets[i].size < sets[j].size:
            i, j = j, i
        root[j] = i
        into, other = sets[i], sets[j]
        sets[j] = None
        for p in other:
            before, after = into.add(p)
            for a, b in ((before, p), (p, after)):
                if a >= 0 and 0 < b - a <= shared and (a == 0 or own[a - 1] != own[b - 1] or of[a - 1] != of[a]):
                    key = (a, b - a)
                    if seeds.get(key, 0) < shared:
                        seeds[key] = shared
    best: dict[tuple[int, int], int] = {}
    for (start, period), shared in seeds.items():
        length = period + shared
        if length >= max(least, times * period):
            best[start, length] = min(best.get((start, length), period), period)
    return sorted((start, length, period) for (start, length), period in best.items())


def runs_of(words: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period."""
    sizes = np.array(list(map(len, words)), np.int64)
    first = np.cumsum(sizes) - sizes
    known: dict[bytes, int] = {}
    word = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(words)), sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for start, length, period in find_runs(word, text, least, times) if len(word) else ():
        found[text[start]].append((start - int(first[text[start]]), length, period))
    return [sorted(rs, key=lambda r: (r[0], r[2])) for rs in found]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: of every run its first period stays."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, g in zip(words, gone) if not g]


def collapsed(docs: DataFrame, text: str | Column = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc`` (struct of the input row), ``runs`` (by start, then period) and ``collapsed`` (kept words, joined by blanks).

    A run is a stretch of words with smallest period q, at least ``least`` words and ``times`` * q long, that no
    neighbouring word extends. Null, empty and blank texts have no runs and an empty ``collapsed``; repeated rows repeat
    their result; an empty table gives an empty one; other columns are only carried inside ``doc``. Texts are read whole
    in portions of about two megabytes; one text is never split, so memory grows with the longest text (about 200 bytes
    for each of its words).
    """
    value = F.col(text) if isinstance(text, str) else text
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(value, F.lit("")).alias("text"))

    def judged(batches):
        for b in batches:
            texts, k = b.column("text").to_pylist(), 0
            runs, kept = [], []
            while k < len(texts):
                size, words = 0, []
                while k < len(texts) and size < PORTION:
                    raw = texts[k].encode()
                    words.append(raw.split())
                    size, k = size + len(raw) + 1, k + 1
                own = runs_of(words, least, times)
                runs += own
                kept += [b" ".join(collapse(ws, rs)).decode() for ws, rs in zip(words, own)]
            flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
            entries = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "length", "period"])
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.ListArray.from_arrays(pa.array(ends), entries), pa.array(kept, pa.string())], ["doc", "runs", "collapsed"])

    schema = rows.select("doc", F.lit(None).cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema
    return rows.mapInArrow(judged, schema)
