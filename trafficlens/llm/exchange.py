"""Sums per hash over all blocks, sent back to every block that asked, in steps whose rows grow in proportion to the blocks.

A block cuts its sorted hashes into slices by their leading bits, at most 2**``bits`` of them. As long as there are no more
blocks than that, one task adds up a slice of every block and answers. With more, tasks first merge the slices of some
2**bits blocks each; what comes out is again no larger than a block and asks in the same way, one step deeper, within its
range of hashes. Its answers are dealt out to the slices it was merged from. So no step makes more than 2**bits rows of
a block, and no task holds more than about a block's worth of hashes.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import written

BITS = 10
SLICES = "node long, source long, hashes binary, counts binary"
ANSWERS = "node long, source long, totals binary, types long"


def packed(array: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane, compressed."""
    import zstandard

    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T if len(array) else array.view(np.uint8)
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def first_cuts(n_blocks: int, bits: int) -> int:
    """Slices of each block in the first step."""
    return max(min(n_blocks, 1 << bits), 1)


def sliced(source: int, hashes: np.ndarray, values: np.ndarray, cuts: int, node: int = 0, used: int = 0) -> pa.RecordBatch:
    """Sorted hashes that agree in ``used`` leading bits, and their values, cut into ranges of the next bits; ``node`` is the first range's number."""
    bucket = (((hashes << np.uint64(used)) >> np.uint64(32)) * np.uint64(cuts)) >> np.uint64(32)
    which, first = np.unique(bucket, return_index=True)
    parts = list(zip(first, np.r_[first[1:], len(hashes)]))
    columns = [pa.array([packed(np.diff(hashes[i:j], prepend=np.uint64(0))) for i, j in parts], pa.binary()), pa.array([packed(values[i:j]) for i, j in parts], pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64) + node), pa.array(np.full(len(which), source)), *columns], ["node", "source", "hashes", "counts"])


def sorted_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the keys, equal ones by place, and where each distinct key starts in it; leaner than ``np.unique``.

    Sorts the leading bits in which keys differ and the place as one number, much faster than by an index, and puts the few keys right that agree in those bits.
    """
    if not len(keys):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    alike, low = np.uint64(64 - int(keys.min() ^ keys.max()).bit_length()), np.uint64(len(keys).bit_length())
    lead = lambda x: x << alike >> low if alike < 64 else np.zeros_like(x)
    places = lead(keys)
    places <<= low
    places |= np.arange(len(keys), dtype=np.uint32)
    places.sort()
    places &= np.uint64((1 << int(low)) - 1)
    order = places.astype(np.int32)
    del places
    ranked = keys[order]
    wrong = np.flatnonzero(ranked[1:] < ranked[:-1])
    if len(wrong) > len(keys) >> 10:
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        wrong = wrong[:0]
    for k in wrong.tolist():
        i, j, own = k, k + 1, lead(ranked[k])
        while i and lead(ranked[i - 1]) == own:
            i -= 1
        while j < len(keys) and lead(ranked[j]) == own:
            j += 1
        order[i:j] = order[i:j][np.argsort(ranked[i:j], kind="stable")]
        ranked[i:j] = keys[order[i:j]]
    return order, np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])


class Merged:
    """Slices of one range of hashes, in order of their source, added up per hash."""

    def __init__(self, group: pd.DataFrame, kind: str):
        self.group = group.sort_values("source")
        hashes = [np.cumsum(unpacked(x, "<u8"), dtype=np.uint64) for x in self.group["hashes"]]
        self.cuts, keys = np.cumsum([len(h) for h in hashes])[:-1], np.concatenate(hashes)
        del hashes
        self.order, self.start = sorted_runs(keys)
        self.hashes = keys[self.order[self.start]]
        values = np.concatenate([unpacked(x, kind) for x in self.group["counts"]])[self.order]
        self.sums = np.add.reduceat(values, self.start, dtype=np.float64 if kind == "<f8" else np.int64)

    def answers(self, value: np.ndarray, types: int, listed: bool) -> pd.DataFrame:
        """``value`` of each hash in the order of every slice; of odd ones only one slice gets the odd number if ``listed``."""
        whole, out = value & ~1 if listed else value, np.empty(len(self.order), value.dtype)
        out[self.order] = np.repeat(whole, np.diff(self.start, append=len(self.order)))
        if listed:
            out[self.order[self.start]] += value & 1
        return pd.DataFrame({
            "node": self.group["node"].to_numpy(), "source": self.group["source"].to_numpy(),
            "totals": [packed(x) for x in np.split(out, self.cuts)], "types": [types] + [0] * (len(self.group) - 1),
        })


def looked_up(slices: DataFrame, n: int, kind: str, answer: Callable[[np.ndarray], np.ndarray], listed: bool = False, bits: int = BITS, used: int = 0) -> DataFrame:
    """``ANSWERS``: per slice what ``answer`` makes of the sums of its hashes. ``types`` counts the hashes with a sum, each range's on one row.

    ``slices`` come from :func:`sliced` with :func:`first_cuts` of ``n`` sources, values of numpy type ``kind``. If ``listed``,
    odd answers are odd in one source only.
    """
    if n <= 1 << bits:

        def answered(group: pd.DataFrame) -> pd.DataFrame:
            own = Merged(group, kind)
            return own.answers(answer(own.sums), int((own.sums > 0).sum()), listed)

        return slices.groupBy("node").applyInPandas(answered, ANSWERS)

    packs = -(-n // (1 << bits))
    slices = written(slices.withColumn("pack", F.pmod(F.xxhash64("source"), F.lit(packs))), "exchange")

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        own, node = Merged(group, kind), int(group["node"].iloc[0])
        return sliced(int(group["pack"].iloc[0]), own.hashes, own.sums, first_cuts(packs, bits), node << bits, used + bits).to_pandas()

    wider = "<f8" if kind == "<f8" else "<i8"
    deeper = looked_up(slices.groupBy("node", "pack").applyInPandas(merged, SLICES), packs, wider, answer, listed, bits, used + bits)
    deeper = deeper.select(F.shiftright("node", bits).alias("node"), F.col("source").alias("pack"), F.col("node").alias("range"), "totals", "types")

    def dealt(group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        value = np.concatenate([unpacked(x, wider) for x in found.sort_values("range")["totals"]])
        return Merged(group, kind).answers(value, int(found["types"].sum()), listed)

    return slices.groupBy("node", "pack").cogroup(deeper.groupBy("node", "pack")).applyInPandas(dealt, ANSWERS)
