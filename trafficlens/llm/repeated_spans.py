"""Suffix-array de-duplication of long repeated byte strings: front-coded sorted suffix runs, merged without comparing known prefixes again.

Only suffixes at anchors are sorted. The anchor of a 50-byte window is the place in it whose 20 following bytes hash least,
so equal windows have equal anchors at equal places in them, and a text has an anchor every 16 bytes or so. Neighbouring
windows with one anchor form a stretch. Stretches found whole in a smaller document, by 128 bits of two independent
hashes, need no comparison; the others with an anchor string in common are the suffixes that are sorted, merged and compared
byte by byte. An anchor string with very many of them is dealt out further: its windows are the sorted strings then, by
the hash of their bytes.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import BASE, powers, written
from trafficlens.llm.exchange import packed, unpacked

WIDTH, ANCHOR = 50, 20
LEFT = WIDTH - ANCHOR  # bytes of a window before its anchor, at most
BLOCK_BYTES = 2 << 20
CHUNK = 1 << 18  # window starts that are hashed at once
BUCKET_BYTES = 4 << 20  # of text per bucket of anchor strings
HOT = 1 << 16  # stretches of one anchor string that are merged in one task; of more the windows are, in as many as there are buckets
NO_ID = (1 << 63) - 1  # documents without an id count as the largest

MASK48 = np.uint64((1 << 48) - 1)
# A second hash of byte strings, with numbers of its own for the bytes.
SECOND_BASE = 0xD1342543DE82EF95
BYTE_NUMBERS = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def stretches(raw: np.ndarray, ends: np.ndarray):
    """Per chunk of window starts: (anchor, first, last window start, anchor hash, stretch hash, its second hash) as arrays of places in ``raw``.

    ``ends`` are the ends of the documents in ``raw``; windows lie within one document.
    """
    up, down = powers(CHUNK + WIDTH + 1)
    up2, down2 = powers(CHUNK + WIDTH + 1, SECOND_BASE)
    for base in range(0, len(raw), CHUNK):
        part = raw[base : base + CHUNK + WIDTH - 1]
        starts = min(CHUNK, len(part) - WIDTH + 1)
        if starts <= 0:
            continue
        n = len(part)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(part * up[:n], out=sums[1:])
            grams = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
        low = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
        # Least of every 31 neighbours: ranges of 16, 24, 28, 30 and 31 by doubling and shifting.
        size = 1
        while size < LEFT + 1:
            step = min(size, LEFT + 1 - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        anchor = (low & np.uint64((1 << 20) - 1)).astype(np.int64)[:starts]
        doc = np.searchsorted(ends, base + np.arange(starts), "right")
        inside = base + np.arange(starts) + WIDTH <= ends[doc]
        first = np.flatnonzero(inside & np.r_[True, (anchor[1:] != anchor[:-1]) | ~inside[:-1]])
        if not len(first):
            continue
        last = np.flatnonzero(inside & np.r_[(anchor[1:] != anchor[:-1]) | ~inside[1:], True])
        own = anchor[first]
        with np.errstate(over="ignore"):
            text = (sums[last + WIDTH] - sums[first]) * down[first]
            whole = mixed(mixed(text) + (own - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + (last - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            np.cumsum(BYTE_NUMBERS[part] * up2[:n], out=sums[1:])
            second = mixed((sums[last + WIDTH] - sums[first]) * down2[first])
        yield own + base, first + base, last + base, grams[own] >> np.uint64(16), whole & MASK48, second


class Block:
    """A pack of documents and its distinct stretches in order of (anchor hash, stretch hash)."""

    def __init__(self, row):
        import zstandard

        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(int(row["size"]), 1)), np.uint8)
        self.ids, self.ends = unpacked(row["ids"], "<i8"), unpacked(row["ends"], "<i8")
        parts = list(stretches(self.raw, self.ends))
        self.anchor, self.first, self.last = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(3))
        gram, whole, second = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.uint64) for k in (3, 4, 5))
        self.id = self.ids[np.searchsorted(self.ends, self.first, "right")]
        order = np.lexsort((self.id, second, whole, gram))
        gram, whole, second = gram[order], whole[order], second[order]
        new = np.r_[True, (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1]) | (second[1:] != second[:-1])] if len(order) else np.empty(0, bool)
        self.gram, self.whole, self.second, self.least, self.any = gram[new], whole[new], second[new], self.id[order][new], order[new]
        self.pair = np.empty(len(order), np.int64)  # distinct stretch of every stretch
        self.pair[order] = np.cumsum(new) - 1
        self.key = mixed(self.gram ^ mixed(self.whole + np.uint64(1)))
        self.by_key = np.argsort(self.key, kind="stable")
        self.group = np.flatnonzero(np.r_[True, self.gram[1:] != self.gram[:-1]]) if len(self.gram) else np.empty(0, np.int64)
        self.group_of = np.repeat(np.arange(len(self.group)), np.diff(np.r_[self.group, len(self.gram)]))

    def stretch_slices(self, buckets: int):
        """(bucket, distinct stretches in order of their key) by ranges of the key."""
        for bucket, i, j in ranges(self.key[self.by_key] >> np.uint64(32), buckets):
            yield bucket, self.by_key[i:j]

    def group_slices(self, buckets: int):
        """(bucket, first, end) of the anchor strings, by ranges of their hash."""
        return ranges(self.gram[self.group] >> np.uint64(16), buckets)

    def windows(self, pairs: np.ndarray):
        """(distinct stretch, distance to the anchor, number of its bytes) of every window of some distinct stretches, and the distinct bytes, sorted."""
        place = self.any[pairs]
        count = (self.last - self.first)[place] + 1
        start = np.repeat(self.first[place], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        strings = self.raw[start[:, None] + np.arange(WIDTH)].reshape(-1, WIDTH)
        wide = np.zeros((len(strings), -(-WIDTH // 8) * 8), np.uint8)
        wide[:, :WIDTH] = strings
        wide = wide.view(">u8").astype(np.uint64)
        order = np.lexsort(wide.T[::-1])
        new = np.r_[np.ones(min(len(order), 1), bool), (wide[order][1:] != wide[order][:-1]).any(axis=1)]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return np.repeat(pairs, count), np.repeat(self.anchor[place], count) - start, number, strings[order[new]]


def ranges(high: np.ndarray, buckets: int):
    """(bucket, first, end) of sorted 32-bit numbers by equal ranges."""
    bucket = (high * np.uint64(buckets)) >> np.uint64(32)
    which, first = np.unique(bucket, return_index=True)
    return zip(which.tolist(), first.tolist(), np.r_[first[1:], len(bucket)].tolist())


def packs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents packed into blocks: compressed bytes, ids, ends; ``null`` marks documents without an id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def batched(batches):
        import zstandard

        base, k, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def batch():
            raw, marks = b"".join(texts), np.array([i is None for i in ids], np.uint8)
            own = np.array([NO_ID if i is None else i for i in ids], np.int64)
            columns = [[base + k], [len(raw)], [zstandard.compress(raw, 3)], [packed(own)], [packed(marks)], [packed(np.cumsum([len(t) for t in texts], dtype=np.int64))]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.binary()] * 4)], ["block", "size", "text", "ids", "marks", "ends"])

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                ids.append(i)
                texts.append(t.encode())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield batch()
                    k, ids, texts, size = k + 1, [], [], 0
        if ids:
            yield batch()

    return written(rows.mapInArrow(batched, "block long, size long, text binary, ids binary, marks binary, ends binary"), "spans-blocks")


def rows_in(batches):
    for b in batches:
        columns = {name: b.column(k) for k, name in enumerate(b.schema.names)}
        for k in range(b.num_rows):
            yield {name: c[k].as_py() for name, c in columns.items()}


ASKED = "kind int, bucket long, block long, hashes binary, low binary, high binary, ids binary, at binary"
ASKED_NAMES = [x.split()[0] for x in ASKED.split(", ")]
STRETCH, GROUP, WINDOW = 0, 1, 2


def known_stretches(blocks: DataFrame, buckets: int) -> DataFrame:
    """Answers to every block by (kind, bucket).

    STRETCH: ``least``, the least document id of each of its stretches in the corpus. GROUP: ``open``, for each of its anchor
    strings 0 if all stretches with it are equal, 1 if not, 2 if there may be more than ``HOT`` of them. Both are asked
    per distinct value of a block and dealt out by its hash, so what is frequent comes once per block.
    """

    def asked(batches):
        for row in rows_in(batches):
            b, out = Block(row), []
            for bucket, own in b.stretch_slices(buckets):
                ids, at = np.unique(b.least[own], return_inverse=True)
                out.append((STRETCH, bucket, row["block"], packed(np.diff(b.key[own], prepend=np.uint64(0))), packed(b.second[own]), None, packed(ids), packed(at.astype(np.uint32))))
            ends = np.r_[b.group[1:], len(b.gram)]
            for bucket, i, j in b.group_slices(buckets):
                low, high = b.whole[b.group[i:j]], b.whole[ends[i:j] - 1]
                out.append((GROUP, bucket, row["block"], packed(np.diff(b.gram[b.group[i:j]], prepend=np.uint64(0))), packed(low), packed(high - low), None, packed((ends - b.group)[i:j].astype(np.uint32))))
            yield batch_of(out)

    def answered(group: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.cumsum(unpacked(x, "<u8")) for x in group["hashes"]]
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        keys = [np.concatenate(hashes)]
        if group["kind"].iloc[0] == STRETCH:
            keys.insert(0, np.concatenate([unpacked(x, "<u8") for x in group["low"]]))
        order = np.lexsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(np.r_[False, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
        n = int(place.max()) + 1
        out = {"kind": group["kind"].to_numpy(), "block": group["block"].to_numpy(), "bucket": group["bucket"].to_numpy(), "least": None, "open": None}
        if group["kind"].iloc[0] == STRETCH:
            doc = np.concatenate([unpacked(x, "<i8")[unpacked(y, "<u4")] for x, y in zip(group["ids"], group["at"])])
            least = np.full(n, NO_ID, np.int64)
            np.minimum.at(least, place, doc)
            smaller = np.where(least[place] < doc, least[place], NO_ID)  # NO_ID: none smaller than the block's own
            out["least"] = [packed(x) for x in np.split(smaller, cuts)]
        else:
            low, wide = (np.concatenate([unpacked(x, "<u8") for x in group[c]]) for c in ("low", "high"))
            least, most = np.full(n, MASK48, np.uint64), np.zeros(n, np.uint64)
            np.minimum.at(least, place, low)
            np.maximum.at(most, place, low + wide)
            many = np.bincount(place, weights=np.concatenate([unpacked(x, "<u4") for x in group["at"]]), minlength=n) > HOT
            code = np.where(least == most, 0, np.where(many, 2, 1)).astype(np.uint8)
            out["open"] = [packed(x) for x in np.split(code[place], cuts)]
        return pd.DataFrame(out)

    slices = blocks.mapInArrow(asked, ASKED)
    return written(slices.groupBy("kind", "bucket").applyInPandas(answered, "kind int, block long, bucket long, least binary, open binary"), "spans-known")


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], ASKED_NAMES)


def open_stretches(b: Block, known: pd.DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(least id elsewhere, 0 closed / 1 to compare / 2 to compare window by window) of the block's distinct stretches."""
    least, code = np.full(len(b.gram), NO_ID, np.int64), np.zeros(len(b.group), np.uint8)
    answers = {(k, x): (y, z) for k, x, y, z in zip(known["kind"], known["bucket"], known["least"], known["open"])}
    for bucket, own in b.stretch_slices(buckets):
        least[own] = unpacked(answers[STRETCH, bucket][0], "<i8")
    for bucket, i, j in b.group_slices(buckets):
        code[i:j] = unpacked(answers[GROUP, bucket][1], "u1")
    return least, np.where(least == NO_ID, code[b.group_of], 0)


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """(common prefix with the one before, remainders, their lengths) of sorted strings."""
    common = np.zeros(len(suffixes), np.uint8)
    for k in range(1, len(suffixes)):
        common[k] = shared(suffixes[k - 1], suffixes[k], 0)
    rest = [s[c:] for s, c in zip(suffixes, common.tolist())]
    return common, b"".join(rest), np.array([len(r) for r in rest], np.uint8)


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings whose first ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    while known < n and a[known] == b[known]:
        known += 1
    return known


def decoded(common: np.ndarray, rest: bytes, lengths: np.ndarray) -> list[bytes]:
    out, last, at = [], b"", 0
    for c, n in zip(common.tolist(), lengths.tolist()):
        last = last[:c] + rest[at : at + n]
        at += n
        out.append(last)
    return out


def merged(runs: list[tuple[list[bytes], list[int]]]) -> list[tuple[int, int, int]]:
    """(run, place in it, common prefix with the string before) of sorted runs with their common prefixes, in sorted order.

    A loser tree. Every waiting string carries its common prefix with the last winner of its match: the longer one wins
    without a look at the bytes, and equal ones are compared behind it only.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at, sizes = [0] * k, [len(r[0]) for r in runs] + [0] * (k - len(runs))
    head = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    prefix = [0] * k  # of each head with the last string given out
    losers = [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if prefix[a] != prefix[b]:
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        n = shared(x, y, prefix[a])
        lose = a if x[n:] > y[n:] or (x[n:] == y[n:] and a > b) else b
        prefix[lose] = n
        return (b, a) if lose == a else (a, b)

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = match(winners[2 * node], winners[2 * node + 1])
    best, out = winners[1], []
    while head[best] is not None:
        strings, own = runs[best]
        out.append((best, at[best], prefix[best]))
        at[best] += 1
        if at[best] < sizes[best]:
            head[best], prefix[best] = strings[at[best]], own[at[best]]
        else:
            head[best] = None
        node = (k + best) >> 1
        while node:
            best, losers[node] = match(best, losers[node])
            node >>= 1
    return out


def runs_of(row: dict, known: pd.DataFrame, buckets: int) -> list[tuple]:
    """Sorted front-coded runs of the block's open stretches, one per bucket; of those with a very frequent anchor string the windows."""
    b, out = Block(row), []
    _, code = open_stretches(b, known, buckets)
    text = b.raw.tobytes()
    import zstandard

    hot, _, number, strings = b.windows(np.flatnonzero(code == 2))
    doc, mark = np.full(len(strings), NO_ID, np.int64), np.zeros(len(strings), np.uint64)
    np.minimum.at(doc, number, b.least[hot])
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            mark = mark * np.uint64(BASE) + strings[:, k] + np.uint64(1)
    order = np.argsort(mixed(mark), kind="stable")
    for bucket, i, j in ranges(mixed(mark)[order] >> np.uint64(32), buckets):
        own = np.sort(order[i:j])
        same = strings[own][1:] == strings[own][:-1]
        common = np.r_[0, same.argmin(axis=1)].astype(np.uint8)
        rest = strings[own][np.arange(WIDTH) >= common[:, None]].tobytes()
        out.append((
            WINDOW, bucket, row["block"], packed(common), zstandard.compress(rest, 3), packed((WIDTH - common).astype(np.uint8)), None, None, None,
            packed(doc[own]), packed(own.astype(np.uint32)), len(rest),
        ))
    for bucket, i, j in b.group_slices(buckets):
        first, end = b.group[i], b.group[j] if j < len(b.group) else len(b.gram)
        pairs = np.flatnonzero(code[first:end] == 1) + first
        if not len(pairs):
            continue
        places = b.any[pairs]
        suffixes = [text[x : y + WIDTH] for x, y in zip(b.anchor[places].tolist(), b.last[places].tolist())]
        order = sorted(range(len(pairs)), key=suffixes.__getitem__)
        common, rest, lengths = front_coded([suffixes[k] for k in order])
        left = [text[x:y].rjust(LEFT, b"\0") for x, y in zip(b.first[places].tolist(), b.anchor[places].tolist())]
        sizes = (b.anchor - b.first)[places][order].astype(np.uint8)
        inner = (b.anchor - b.last)[places][order].astype(np.int8)
        out.append((
            STRETCH, bucket, row["block"], packed(common), zstandard.compress(rest, 3), packed(lengths), zstandard.compress(b"".join(left[k] for k in order), 3),
            packed(sizes), packed(inner), packed(b.least[pairs][order]), packed(pairs[order].astype(np.uint32)), len(rest),
        ))
    return out


RUN_SCHEMA = "kind int, bucket long, block long, common binary, rest binary, lengths binary, lefts binary, sizes binary, inner binary, ids binary, places binary, rest_size long"
RUN_NAMES = [x.split()[0] for x in RUN_SCHEMA.split(", ")]


def compared(group: pd.DataFrame) -> pd.DataFrame:
    """Windows of open stretches that also start in a smaller document: per run the places and a bit per distance to the anchor;
    of single windows the least document.

    The runs are merged; strings that share 50 - d bytes from the anchor are neighbours, and those of them that share the
    d bytes before it hold the same window.
    """
    import zstandard

    group = group.sort_values("block")
    out = {"kind": group["kind"].to_numpy(), "block": group["block"].to_numpy(), "bucket": group["bucket"].to_numpy()}
    single = group["kind"].iloc[0] == WINDOW
    plain = zstandard.ZstdDecompressor()
    runs, left, size, inner, doc = [], [], [], [], []
    for r in group.itertuples():
        common = unpacked(r.common, "u1")
        rest = plain.decompress(r.rest, max_output_size=max(r.rest_size, 1)) if r.rest_size else b""
        runs.append((decoded(common, rest, unpacked(r.lengths, "u1")), common.tolist()))
        doc.append(unpacked(r.ids, "<i8"))
        if single:
            continue
        left.append(np.frombuffer(plain.decompress(r.lefts, max_output_size=max(LEFT * len(common), 1)), np.uint8).reshape(-1, LEFT))
        size.append(unpacked(r.sizes, "u1"))
        inner.append(unpacked(r.inner, "i1"))
    begin = np.cumsum([0, *map(len, doc)])
    order = merged(runs)
    row = np.array([begin[run] + at for run, at, _ in order], np.int64)
    common = np.array([c for _, _, c in order], np.int64)
    back = np.empty(len(row), np.uint64)
    if single:  # equal strings are neighbours that share all their bytes
        doc, new = np.concatenate(doc)[row], common < WIDTH
        new[0] = True
        back[row] = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1].view(np.uint64)
        return pd.DataFrame(out | {"places": group["places"].to_numpy(), "masks": [packed(back[i:j]) for i, j in zip(begin, begin[1:])]})
    left, size, inner, doc = np.concatenate(left)[row], np.concatenate(size)[row].astype(int), np.concatenate(inner)[row].astype(int), np.concatenate(doc)[row]
    mask, before = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
    for d in range(LEFT + 1):
        if d:
            with np.errstate(over="ignore"):
                before = mixed(before * np.uint64(BASE) + left[:, LEFT - d] + np.uint64(1))
        has = np.flatnonzero((size >= d) & (inner <= d))
        if not len(has):
            continue
        together = np.cumsum(common < WIDTH - d)[has]
        by = np.lexsort((doc[has], before[has], together))
        t, h, x = together[by], before[has][by], doc[has][by]
        new = np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])]
        smaller = x[new][np.cumsum(new) - 1] < x
        mask[has[by[smaller]]] |= np.uint64(1 << d)
    back[row] = mask
    return pd.DataFrame(out | {"places": group["places"].to_numpy(), "masks": [packed(back[i:j]) for i, j in zip(begin, begin[1:])]})


def cleaned(row: dict, known: pd.DataFrame, windows: pd.DataFrame, buckets: int):
    """(id or None, bytes, removed runs [(start, end)]) of every document of the block."""
    b = Block(row)
    least, code = open_stretches(b, known, buckets)
    masks = np.zeros(len(b.gram), np.uint64)
    pair, apart, number, strings = b.windows(np.flatnonzero(code == 2))
    smallest = np.full(len(strings), NO_ID, np.int64)
    for kind, at, found in zip(windows["kind"], windows["places"], windows["masks"]):
        at, found = unpacked(at, "<u4").astype(np.int64), unpacked(found, "<u8")
        if kind == WINDOW:
            smallest[at] = found.view(np.int64)
        else:
            masks[at] = found
    seen = smallest[number] < b.least[pair]
    np.bitwise_or.at(masks, pair[seen], np.uint64(1) << apart[seen].astype(np.uint64))
    change = np.zeros(len(b.raw) + 1, np.int64)
    # A stretch whose least document in the corpus or in this block is smaller is covered whole.
    whole = np.minimum(least, b.least)[b.pair] < b.id
    np.add.at(change, b.first[whole], 1)
    np.add.at(change, b.last[whole] + WIDTH, -1)
    some = np.flatnonzero(~whole & (masks[b.pair] > 0))
    for d in range(LEFT + 1):
        at = b.anchor[some[(masks[b.pair[some]] >> np.uint64(d)) & np.uint64(1) > 0]] - d
        np.add.at(change, at, 1)
        np.add.at(change, at + WIDTH, -1)
    covered = np.cumsum(change[:-1]) > 0
    text, marks = b.raw.tobytes(), unpacked(row["marks"], "u1")
    begins = np.r_[0, b.ends[:-1]]
    edge = np.flatnonzero(covered[1:] != covered[:-1]) + 1 if len(covered) else np.empty(0, np.int64)
    for k, (i, j) in enumerate(zip(begins.tolist(), b.ends.tolist())):
        cuts = [i, *edge[np.searchsorted(edge, i, "right") : np.searchsorted(edge, j, "left")].tolist(), j]
        runs = [(x - i, y - i) for x, y in zip(cuts, cuts[1:]) if x < y and covered[x]]
        yield (None if marks[k] else int(b.ids[k])), text[i:j], runs


def digest(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """(bytes, removed, runs, SHA-256 of what is kept)."""
    kept, at = hashlib.sha256(), 0
    for i, j in runs:
        kept.update(text[at:i])
        at = j
    kept.update(text[at:])
    return len(text), sum(j - i for i, j in runs), len(runs), kept.hexdigest()


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``removed``: array of (start, end) in bytes, for every row.

    A byte goes when a 50-byte string over it also starts in a document with a smaller id. Texts travel as compressed blocks,
    hashes of their distinct stretches as sorted slices by ranges of the hash, and open stretches as front-coded sorted runs;
    where a very frequent anchor string would bring too many together, runs of their windows go instead. Null texts are empty;
    ids are whole numbers, a null one is larger than any other; documents with one id do not remove from each other. An empty
    table gives an empty one; other columns are not read. Texts are read whole; one text is never split, so memory grows
    with the longest.
    """
    blocks = packs(docs, doc_id, text)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    known = known_stretches(blocks, buckets)

    def sent(pack: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = runs_of(pack.iloc[0].to_dict(), own, buckets) if len(pack) and len(own) else []
        return pd.DataFrame(out, columns=RUN_NAMES)

    runs = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(sent, RUN_SCHEMA)
    windows = runs.groupBy("kind", "bucket").applyInPandas(compared, "kind int, block long, bucket long, places binary, masks binary")
    answers = known.withColumn("known", F.lit(True)).unionByName(windows.withColumn("known", F.lit(False)), allowMissingColumns=True)

    def applied(pack: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pack):
            first = own["known"].astype(bool)
            for i, t, cut in cleaned(pack.iloc[0].to_dict(), own[first], own[~first], buckets):
                rows.append((i, *digest(t, cut), [{"start": a, "end": z} for a, z in cut]))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])
        out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
        return out

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(applied, schema)
