"""SimHash near-duplicates: generalised pigeonhole over unequal bit partitions, then connected components."""

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import written

SHINGLE, BITS, RADIUS = 4, 64, 4
# Rows of one probe key that meet in one task; larger keys are cut into blocks whose pairs are spread.
BLOCK = 4096


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 (seed 42) of all four-word shingles; zero without words."""
    import xxhash

    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    n = max(len(ws) - SHINGLE + 1, 1)
    joined, ends = b" ".join(ws), list(accumulate(len(w) + 1 for w in ws))
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends]
    hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[min(SHINGLE, len(ws)) - 1 :])], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``fp`` (64 bits as a long)."""
    taken = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(text).alias("text"))

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array([fingerprint(t.as_py()) for t in b.column("text")], pa.int64())], ["kept", "fp"])

    return taken.mapInArrow(hashed, taken.select("kept", F.lit(0).cast("long").alias("fp")).schema).select("kept.*", "fp")


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints with both bits set: partial matrices from the tasks, summed by Spark."""

    def counted(batches):
        total = np.zeros((BITS, BITS))
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype("<i8")
            ones = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += ones.T @ ones
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i * BITS + j), pa.array(total[i, j].astype(np.int64))], ["cell", "n"])

    cells = nodes.select("fp").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(BITS * BITS)
    for cell, n in cells.collect():  # 4,096 at most
        out[cell] = n
    return out.reshape(BITS, BITS)


def grouped_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` groups of near-equal size, each filled with the bits most correlated with it."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free.discard(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, radius: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0, 1, … ``radius`` of the bits with set rates ``p``."""
    dist = np.zeros(radius + 2)
    dist[0] = 1.0
    for d in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    return list(np.cumsum(dist)[: radius + 1])


def plan(both: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition probed, from the least estimated work.

    With thresholds that add up to radius - parts + 1, two fingerprints within the radius agree within the threshold in at
    least one partition; -1 skips a partition. Dynamic programming allocates them by estimated candidates and probes.
    """
    p, best = np.diag(both) / max(n, 1), (float("inf"), [])
    for parts in range(2, radius + 2):
        groups = grouped_bits(both, max(n, 1), parts)
        cost = [[0.0] + [25.0 * n * (1 + sum(comb(len(g), k) for k in range(1, t + 1)) / (2 if t == 1 else 1)) + 0.05 * n * n / 2 * c for t, c in enumerate(within(p[g], radius))] for g in groups]
        # least[s]: least cost of the groups so far whose (threshold + 1) add up to s
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in least.items():
                for t in range(radius + 2):
                    if s + t <= radius + 1:
                        step[s + t] = min(step.get(s + t, (float("inf"), [])), (c + row[t], [*chosen, t - 1]))
            least = step
        best = min(best, (least[radius + 1][0], [(g, t) for g, t in zip(groups, least[radius + 1][1]) if t >= 0]), key=lambda x: x[0])
    return best[1]


def probes(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(key, probe, fp): each fingerprint under its own value of each partition, and as a probe under the values within the threshold.

    At threshold 1 only 0-to-1 flips are probed: of two values one bit apart, one reaches the other that way.
    """

    def dealt(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(fp):
                continue
            for part, (bits, threshold) in enumerate(parts):
                value = np.zeros(len(fp), np.int64)
                for k, bit in enumerate(bits):
                    value |= ((fp >> bit) & 1) << k
                base = np.int64(part) << 40
                yield rows(value | base, fp, False)
                for t in range(1, threshold + 1):
                    for flips in combinations(range(len(bits)), t):
                        mask = np.int64(sum(1 << k for k in flips))
                        chosen = (value & mask) == 0 if threshold == 1 else slice(None)
                        yield rows((value[chosen] ^ mask) | base, fp[chosen], True)

    def rows(key, fp, probe):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), probe)), pa.array(fp)], ["key", "probe", "fp"])

    return nodes.select("fp").mapInArrow(dealt, "key long, probe boolean, fp long")


def spread_keys(rows: DataFrame) -> DataFrame:
    """Adds ``slot``: rows of a key with more than ``BLOCK`` rows are cut into blocks, and every pair of blocks gets a slot."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("alone"))
    useful = sizes.filter("n > 1 and not alone").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(useful, "key").withColumn("own", F.pmod(F.xxhash64("fp", "probe"), F.col("blocks")).cast("int"))
    # Block pair (a, b), a <= b, is slot a * blocks + b; a row of block x goes to all pairs that contain x.
    slots = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("own")) * F.col("blocks") + F.greatest(o, F.col("own")))
    return dealt.select("key", "probe", "fp", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(slots)).alias("slot"))


def links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v), u < v: a spanning forest of the verified links of every (key, slot); pairs themselves are never listed."""

    def linked(batches):
        key, slot, probe, fp = (np.empty(0, t) for t in (np.int64, np.int32, bool, np.int64))
        for b in batches:
            more = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "slot", "probe", "fp")]
            key, slot, probe, fp = (np.concatenate(x) for x in zip((key, slot, probe, fp), more))
            if not len(key):
                continue
            cut = len(key) - np.argmin(((key == key[-1]) & (slot == slot[-1]))[::-1]) if (key[0], slot[0]) != (key[-1], slot[-1]) else 0
            yield pairs(*forest(key[:cut], slot[:cut], probe[:cut], fp[:cut], radius))
            key, slot, probe, fp = key[cut:], slot[cut:], probe[cut:], fp[cut:]
        yield pairs(*forest(key, slot, probe, fp, radius))

    def pairs(u, v):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    dealt = rows.repartition("key", "slot").sortWithinPartitions("key", "slot", "probe")
    return dealt.select("key", "slot", "probe", "fp").mapInArrow(linked, "u long, v long").filter("u <> v").distinct()


def forest(key, slot, probe, fp, radius):
    """Links of the sorted runs of (key, slot): short runs by comparing rows 1, 2, … places apart, long ones by searching out from unvisited rows."""
    u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(key) < 2:
        return u[0], v[0]
    apart = lambda a, b: np.bitwise_count((a ^ b).view(np.uint64))  # noqa: E731  (of signed numbers it counts the bits of the magnitude)
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])])
    size = np.diff(np.r_[start, len(key)])
    run = np.repeat(np.arange(len(start)), size)
    short = (size <= 16)[run]
    sk, sp, sf = run[short], probe[short], fp[short]
    for gap in range(1, min(16, len(sk))):
        # Sorted by probe inside a run: the earlier row must be an indexed one.
        near = np.flatnonzero((sk[gap:] == sk[:-gap]) & ~sp[:-gap] & (apart(sf[gap:], sf[:-gap]) <= radius))
        u.append(sf[near])
        v.append(sf[near + gap])
    for k in np.flatnonzero(size > 16):
        rows = slice(start[k], start[k] + size[k])
        f, p = fp[rows], probe[rows]
        free, todo = np.ones(len(f), bool), []
        for seed in range(len(f)):
            if not free[seed]:
                continue
            free[seed] = False
            todo.append(seed)
            while todo:
                at = todo.pop()
                near = np.flatnonzero(free & (~p | (not p[at])))
                near = near[apart(f[near], f[at]) <= radius]
                free[near] = False
                todo.extend(near.tolist())
                u.append(np.full(len(near), f[at]))
                v.append(f[near])
    return np.concatenate(u), np.concatenate(v)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of an edge. Alternates large and small stars until nothing changes."""
    spark = edges.sparkSession
    now, seen = written(edges.select("u", "v"), "simhash-links"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # Every node points at smaller neighbours: hang them, and the node, below the least of them.
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lower, "v").select("m", F.explode(F.array("u", "v")).alias("v")).select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        now = written(small, "simhash-links")
    if not state[0]:
        return spark.createDataFrame([], "node long, root long")
    stars = now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): fingerprints linked through steps of at most ``radius`` bits share a root. Equal ones are one node."""
    nodes = written(fps.select("fp").distinct(), "simhash-nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("root", F.col("fp"))
    found = links(spread_keys(written(probes(nodes, plan(bit_counts(nodes), n, radius)), "simhash-probes")), radius)
    return nodes.join(components(found).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id whose document is reachable.

    Texts without words (null, empty, blank) have fingerprint zero and are linked like others. Repeated rows and ids are
    documents of their own; a component without any id has a null one. An empty table gives an empty one; other
    columns are not read.
    """
    fps = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ("doc_id",)), "simhash-fingerprints")
    known = written(classes(fps, radius), "simhash-classes")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(known, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(known.join(first, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The input rows, one of each component (the smallest id, null ids last; of equal ids any one), columns unchanged."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))
    rows = written(rows, "simhash-rows")
    fps = written(fingerprints(rows.select("row", F.col(f"doc.{doc_id}").alias("id"), F.col(f"doc.{text}").alias("text")), ("row", "id")), "simhash-fingerprints")
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row"))
    first = fps.groupBy("fp").agg(F.min(order).alias("best")).join(classes(fps, radius), "fp").groupBy("root").agg(F.min("best").alias("best"))
    return rows.join(first.select(F.col("best.row").alias("row")), "row", "left_semi").select("doc.*")
