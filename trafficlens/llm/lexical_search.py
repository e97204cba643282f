"""Ranked lexical search by two trees: node pairs of items and documents are pruned by bounds from coordinate maxima."""

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappush, heapreplace
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trafficlens.llm.common import written
from trafficlens.llm.exchange import packed, unpacked

# One pass over the documents serves at most so many items, distinct terms and bytes of item text (at least one item).
MOST_ITEMS, MOST_TERMS, MOST_BYTES = 1024, 1 << 15, 4 << 20
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20  # documents that share a tree
ITEM_LEAF, ITEM_FAN, DOC_LEAF, DOC_FAN = 4, 4, 32, 8
SEEDS = 64  # one block of so many is searched first, so that the others start with its kth scores
NO_ID = (1 << 63) - 1

# Bytes of a term: digits, letters and all of UTF-8 beyond ASCII; A-Z become a-z, the rest blanks.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Sparse:
    """Rows of (term, value), and per row the bounds in the flat arrays."""

    terms: np.ndarray
    values: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, rows: list[dict[int, int]]) -> "Sparse":
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = [np.array([x for r in rows for x in kind(r)], np.int64) for kind in (dict.keys, dict.values)]
        return cls(flat[0], flat[1].astype(np.float64), np.r_[0, np.cumsum(sizes)])

    def rows(self, chosen: np.ndarray) -> "Sparse":
        sizes = np.diff(self.ends)[chosen]
        ends = np.r_[0, np.cumsum(sizes)]
        at = np.repeat(self.ends[chosen] - ends[:-1], sizes) + np.arange(ends[-1])
        return Sparse(self.terms[at], self.values[at], ends)

    def products(self, dense: np.ndarray) -> np.ndarray:
        """Of every dense row with every sparse row; whole numbers below 2**53 come out exact."""
        if not len(self.terms):
            return np.zeros((len(dense), len(self.ends) - 1))
        taken = np.hstack([dense[:, self.terms] * self.values, np.zeros((len(dense), 1))])
        return np.add.reduceat(taken, self.ends[:-1], axis=1) * (np.diff(self.ends) > 0)


class ItemTree:
    """Levels from the leaves up; a node has the greatest multiplicity of each term among its items, a leaf a few items."""

    def __init__(self, items: list[dict[int, int]], rarity: np.ndarray):
        # Items that share their rarest term lie together.
        key = [max(((rarity[t], t) for t in r), default=(-1.0, -1)) for r in items]
        self.order = np.array(sorted(range(len(items)), key=lambda i: (key[i], i)), np.int64)
        rows = [items[i] for i in self.order]
        self.items, self.first, self.levels, self.size = Sparse.of(rows), [], [], len(rows)
        fan = ITEM_LEAF
        while True:
            first = np.arange(0, len(rows), fan)
            merged: list[dict[int, int]] = []
            for k in first.tolist():
                node: dict[int, int] = {}
                for r in rows[k : k + fan]:
                    for t, v in r.items():
                        node[t] = max(node.get(t, 0), v)
                merged.append(node)
            self.first.append(np.r_[first, len(rows)])
            self.levels.append(Sparse.of(merged))
            rows, fan = merged, ITEM_FAN
            if len(rows) <= 1:
                break

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Children of the nodes (for leaves: places of items)."""
        a, b = self.first[level][nodes], self.first[level][nodes + 1]
        return np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange((b - a).sum())

    def weakest(self, kth: np.ndarray) -> list[np.ndarray]:
        """Per level and node the least kth score of its items, 1 at least: scores are whole and count above zero."""
        out, at = [], np.maximum(kth, 1)
        for first in self.first:
            at = np.minimum.reduceat(at, first[:-1])
            out.append(at)
        return out


class DocTree:
    """A block of documents with their score parts per term; levels of coordinate maxima from the leaves up."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, n_docs: int, n_terms: int, rarity: np.ndarray):
        self.n_terms = n_terms
        # Documents that share their rarest term lie together, copies among them.
        key = np.full(n_docs, -1.0)
        np.maximum.at(key, doc, rarity[term] * n_terms + term)
        self.order = np.argsort(key, kind="stable")
        place = np.empty(n_docs, np.int64)
        place[self.order] = np.arange(n_docs)
        doc = place[doc]
        by = np.argsort(doc, kind="stable")
        self.doc, self.term, self.part = doc[by], term[by], part[by].astype(np.float64)
        self.begin = np.searchsorted(self.doc, np.arange(0, n_docs + DOC_LEAF, DOC_LEAF))
        leaves = np.zeros((-(-n_docs // DOC_LEAF), n_terms))
        np.maximum.at(leaves.reshape(-1), self.doc // DOC_LEAF * n_terms + self.term, self.part)
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), DOC_FAN)))

    def leaf(self, k: int) -> np.ndarray:
        """Score parts of a leaf's documents."""
        own = slice(self.begin[k], self.begin[k + 1])
        out = np.zeros((DOC_LEAF, self.n_terms))
        out[self.doc[own] - k * DOC_LEAF, self.term[own]] = self.part[own]
        return out


class Search:
    """The best documents of every item so far. ``floors``: scores that an item's kth best reaches anyhow."""

    def __init__(self, items: list[dict[int, int]], rarity: np.ndarray, k: int, floors: np.ndarray):
        self.tree, self.rarity, self.k = ItemTree(items, rarity), rarity, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in items]
        self.kth = floors[self.tree.order].astype(np.float64)
        self.bounds = self.tree.weakest(self.kth)

    def block(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, part: np.ndarray) -> None:
        if not len(doc) or not self.tree.size:
            return
        docs = DocTree(doc, term, part, len(ids), len(self.rarity), self.rarity)
        self.descend(docs, ids[docs.order], len(docs.levels) - 1, np.array([0]), len(self.tree.levels) - 1, np.array([0]))

    def descend(self, docs: DocTree, ids: np.ndarray, upto: int, nodes: np.ndarray, level: int, items: np.ndarray) -> None:
        """Pairs of document nodes and item nodes of one level each; those whose bound can still matter go on to their children.

        A bound equal to the weakest kth score stays: an equal score with a smaller id counts.
        """
        reach = self.tree.levels[level].rows(items).products(docs.levels[upto][nodes])
        for n in np.argsort(-reach.max(axis=1), kind="stable").tolist():
            alive = items[reach[n] >= self.bounds[level][items]]
            if not len(alive):
                continue
            if upto:
                below = np.arange(nodes[n] * DOC_FAN, min((nodes[n] + 1) * DOC_FAN, len(docs.levels[upto - 1])))
                self.descend(docs, ids, upto - 1, below, max(level - 1, 0), self.tree.below(level, alive) if level else alive)
            elif level:
                self.descend(docs, ids, 0, nodes[n : n + 1], level - 1, self.tree.below(level, alive))
            else:
                self.settle(docs, ids, int(nodes[n]), self.tree.below(0, alive))

    def settle(self, docs: DocTree, ids: np.ndarray, leaf: int, places: np.ndarray) -> None:
        """Exact scores of a leaf's documents for the items at ``places``."""
        scores = self.tree.items.rows(places).products(docs.leaf(leaf))
        good = scores >= np.maximum(self.kth[places], 1)
        if not good.any():
            return
        for d, i in np.argwhere(good).tolist():
            p = places[i]
            best, entry = self.best[p], (int(scores[d, i]), -int(ids[leaf * DOC_LEAF + d]))
            if len(best) < self.k:
                heappush(best, entry)
            elif entry > best[0]:
                heapreplace(best, entry)
            if len(best) == self.k:
                self.kth[p] = max(self.kth[p], best[0][0])
        self.bounds = self.tree.weakest(self.kth)

    def rows(self) -> Iterator[tuple[int, int, int]]:
        """(number of the item, id, score)."""
        for p, best in enumerate(self.best):
            for score, minus in best:
                yield int(self.tree.order[p]), -minus, score


INDEX = "block long, ids binary, sizes binary, held binary, terms binary, times binary, n_docs long, n_terms long, df binary"


def index(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """Documents in blocks, with the vocabulary's terms they hold; one more row per task has its counts.

    ``sizes``: terms of each document with repeats, ``held``: distinct ones of the vocabulary, ``terms`` and ``times``: those, in
    order of documents. Counts: documents with a term, terms with repeats, and per vocabulary term the documents that hold it.
    """
    kinds = [pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.int64(), pa.binary()]
    names = ["block", "ids", "sizes", "held", "terms", "times", "n_docs", "n_terms", "df"]

    def record(row):
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    def packs(batches):
        from pyspark import TaskContext

        df, n_docs, n_terms, number = np.zeros(len(vocabulary), np.int64), 0, 0, TaskContext.get().partitionId() << 32
        ids, sizes, held, terms, times, size = [], [], [], [], [], 0

        def block():
            found = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (terms, times)]
            np.add.at(df, found[0], 1)
            return record([number, packed(np.array(ids, np.int64)), packed(np.array(sizes, np.int64)), packed(np.array(held, np.uint32)), packed(found[0].astype(np.uint32)), packed(found[1].astype(np.uint32)), None, None, None])

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                words = terms_of(t)
                n_docs, n_terms = n_docs + bool(words), n_terms + len(words)
                own = np.array([x for x in map(vocabulary.get, words) if x is not None], np.int64)
                own, count = np.unique(own, return_counts=True)
                ids.append(NO_ID if i is None else i)
                sizes.append(len(words))
                held.append(len(own))
                terms.append(own)
                times.append(count)
                size += len(t or "")
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_ROWS:
                    yield block()
                    ids, sizes, held, terms, times, size, number = [], [], [], [], [], 0, number + 1
        if ids:
            yield block()
        yield record([None, None, None, None, None, None, n_docs, n_terms, packed(df)])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(packs, INDEX), "search-index")


def totals(rows: DataFrame, n: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms, and documents per vocabulary term (at most ``MOST_TERMS`` numbers reach the driver)."""

    def added(batches):
        df, docs, terms = np.zeros(n, np.int64), 0, 0
        for b in batches:
            docs, terms = docs + sum(b.column("n_docs").to_pylist()), terms + sum(b.column("n_terms").to_pylist())
            for x in b.column("df").to_pylist():
                df += unpacked(x, "<i8")
        values = np.r_[docs, terms, df]
        at = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values[at])], ["place", "n"])

    counts = rows.filter("df is not null").select("n_docs", "n_terms", "df").mapInArrow(added, "place long, n long")
    out = np.zeros(n + 2, np.int64)
    for r in counts.groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return int(out[0]), int(out[1]), out[2:]


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[dict[int, int]], dict[bytes, int]]]:
    """(ids, terms with multiplicity, vocabulary) of runs of items within the bounds of one pass."""
    ids, rows, vocabulary, size = [], [], {}, 0
    for r in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        counts: dict[int, int] = {}
        for w in terms_of(r["t"]):
            k = vocabulary.setdefault(w, len(vocabulary))
            counts[k] = counts.get(k, 0) + 1
        ids.append(r["i"])
        rows.append(counts)
        size += len(r["t"] or "")
        if len(ids) >= MOST_ITEMS or len(vocabulary) >= MOST_TERMS or size >= MOST_BYTES:
            yield ids, rows, vocabulary
            ids, rows, vocabulary, size = [], [], {}, 0
    if ids:
        yield ids, rows, vocabulary


def search_block(docs: DataFrame, items: list[dict[int, int]], vocabulary: dict[bytes, int], k: int, doc_id: str, text: str) -> DataFrame:
    """(item number, rank, doc_id, score) of a block of items."""
    rows = index(docs, vocabulary, doc_id, text)
    n_docs, n_terms, df = totals(rows, len(vocabulary))
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    rarity = -df.astype(np.float64)

    def searched(floors: np.ndarray):
        def run(batches):
            search = Search(items, rarity, k, floors)
            for b in batches:
                for ids, sizes, held, terms, times in zip(*(b.column(c).to_pylist() for c in ("ids", "sizes", "held", "terms", "times"))):
                    ids, sizes, held = unpacked(ids, "<i8"), unpacked(sizes, "<i8"), unpacked(held, "<u4").astype(np.int64)
                    term, tf = unpacked(terms, "<u4").astype(np.int64), unpacked(times, "<u4").astype(np.int64)
                    doc = np.repeat(np.arange(len(ids)), held)
                    damp = 25 + (75 * sizes * n_docs) // max(n_terms, 1)
                    search.block(ids, doc, term, weights[term] * ((1000000000 * tf) // (1000 * tf + 8 * damp[doc])))
            found = list(zip(*search.rows())) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["item", "doc_id", "score"])

        return run

    schema = "item long, doc_id long, score long"
    blocks = rows.filter("block is not null")
    is_seed = F.pmod(F.xxhash64("block"), F.lit(SEEDS)) == 0
    by_rank = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)
    columns = ("ids", "sizes", "held", "terms", "times")
    seeds = written(ranked(blocks.filter(is_seed).select(*columns).mapInArrow(searched(np.zeros(len(items), np.int64)), schema)), "search-seeds").drop("rank")
    floors = np.zeros(len(items), np.int64)
    for r in seeds.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k).collect():
        floors[r["item"]] = r["score"]
    rest = blocks.filter(~is_seed).select(*columns).mapInArrow(searched(floors), schema)
    best = ranked(rest.unionByName(seeds)).select("item", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
    return written(best, "search-best")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, scores above 0, equal scores by ascending id.

    Every row of ``items`` is an item and every row of ``docs`` a document of its own, repeated ones too. Null texts have
    no terms; items without terms, and empty tables, give no rows. Documents with a null id come last among equal scores;
    ids are whole numbers. Other columns are not read. Texts are read whole, one at a time. Items are served in blocks, each
    with one pass over the documents: the block's terms (bounded, see ``MOST_TERMS``) go to the tasks, which index their
    documents; document blocks then meet the tree of the items.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for ids, rows, vocabulary in item_blocks(items, item_id, item_text):
        if vocabulary:
            names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind}")
            found = search_block(docs, rows, vocabulary, k, doc_id, text)
            out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
