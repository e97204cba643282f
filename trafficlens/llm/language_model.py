"""LM scoring: smoothed word n-grams as a weighted backoff automaton; every block of texts walks the part of it that it meets."""

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import written
from trafficlens.llm.exchange import BITS, SLICES, first_cuts, looked_up, packed, sliced, sorted_runs, unpacked

ADD = 0.1  # added to every count of the unigram model
DISCOUNT = 0.75  # taken from every kept longer n-gram
ORDER = 3
LEAST = 2  # longer n-grams that occur so often in the training texts are kept, at any size of corpus
BLOCK_BYTES = 8 << 20  # of text that is scored with one extract of the model
END = b"\n"  # the end token: no word contains it
NO_ARC = 1.0  # in place of a weight, which is never above zero
WALK = 1 << 16  # places whose weights are laid out at once

BLOCK_SCHEMA = "block long, ids binary, marks binary, ends binary, tokens binary, hashes binary, counts binary, n_train long"


def blocks(docs: DataFrame, doc_id: str, text: str, held: Column) -> DataFrame:
    """Documents packed into blocks: token numbers into the block's sorted distinct word hashes, and the counts of its training texts.

    ``marks`` of a document: 1 held out, 2 without an id.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))

    def pack(block, ids, held, texts):
        import xxhash

        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__  # a new word gets the next number
        parts, ends, at = [], [], 0
        for t in texts:
            ws = t.lower().split()
            ws.append(END)
            at += len(ws)
            ends.append(at)
            parts.append(np.fromiter(map(known.__getitem__, ws), np.uint32, len(ws)))
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
        hashes, place = np.unique(own, return_inverse=True)
        tokens, ends = place.astype(np.uint32)[np.concatenate(parts)], np.array(ends, np.int64)
        learnt = ~np.repeat(np.array(held, bool), np.diff(ends, prepend=0))
        counts = np.bincount(tokens[learnt], minlength=len(hashes)).astype(np.uint32)
        marks = np.array([h + 2 * (i is None) for h, i in zip(held, ids)], np.uint8)
        return [block, packed(np.array([i or 0 for i in ids], np.int64)), packed(marks), packed(ends), packed(tokens), packed(hashes), packed(counts), int(learnt.sum())]

    def batched(batches):
        ids, held, texts, size, k = [], [], [], 0, 0
        base = TaskContext.get().partitionId() << 32
        for b in batches:
            for i, h, t in zip(b.column("id").to_pylist(), b.column("held").to_pylist(), b.column("text").to_pylist()):
                ids.append(i)
                held.append(h)
                texts.append(t.encode())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield batch([pack(base + k, ids, held, texts)])
                    ids, held, texts, size, k = [], [], [], 0, k + 1
        if ids:
            yield batch([pack(base + k, ids, held, texts)])

    kinds = [pa.int64(), *[pa.binary()] * 6, pa.int64()]
    names = ["block", "ids", "marks", "ends", "tokens", "hashes", "counts", "n_train"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return written(rows.mapInArrow(batched, BLOCK_SCHEMA), "lm-blocks")


def totals(packs: DataFrame, n_blocks: int, bits: int) -> DataFrame:
    """Corpus counts of the words, back to every block that has them; ``types`` adds up to the distinct training words."""
    cuts = first_cuts(n_blocks, bits)

    def dealt(batches):
        for b in batches:
            for block, hashes, counts in zip(*(b.column(c).to_pylist() for c in ("block", "hashes", "counts"))):
                yield sliced(block, unpacked(hashes, "<u8"), unpacked(counts, "<u4"), cuts)

    slices = packs.select("block", "hashes", "counts").mapInArrow(dealt, SLICES)
    return written(looked_up(slices, n_blocks, "<u4", lambda sums: sums, bits=bits), "lm-totals")


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams from those of their first words and of their last word."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@dataclass
class Grams:
    """The n-grams of two words or more of a block.

    ``keys``: their sorted distinct hashes; ``size`` and ``before``: words, and hash of all but the last, of each; ``at``: per
    order from two the places of the block where one ends, and their numbers among ``keys``.
    """

    keys: np.ndarray
    size: np.ndarray
    before: np.ndarray
    at: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, hashes: np.ndarray, tokens: np.ndarray, ends: np.ndarray, order: int) -> "Grams":
        word = hashes[tokens]
        place = np.arange(len(word), dtype=np.int32) - np.repeat(np.r_[0, ends[:-1]].astype(np.int32), np.diff(ends, prepend=0))
        every, spots = [word], []
        for n in range(1, order):
            longer = np.zeros_like(word)
            longer[1:] = mixed(every[-1][:-1], word[1:])
            every.append(longer)
            spots.append(np.flatnonzero(place >= n).astype(np.int32))
        del place
        found = np.concatenate([key[spot] for key, spot in zip(every[1:], spots)])
        every.pop()
        ranks, start = sorted_runs(found)
        first = ranks[start]
        keys, number = found[first], np.empty(len(found), np.int32)
        del found
        number[ranks] = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(start, append=len(ranks)))
        del ranks, start
        cuts = np.cumsum([0, *[len(x) for x in spots]])
        size, before = np.empty(len(keys), np.uint8), np.empty(len(keys), np.uint64)
        for k, spot in enumerate(spots):
            own = np.flatnonzero((first >= cuts[k]) & (first < cuts[k + 1]))
            size[own], before[own] = k + 2, every[k][spot[first[own] - cuts[k]] - 1]
        return cls(keys, size, before, list(zip(spots, np.split(number, cuts[1:-1]))))


def gram_totals(packs: DataFrame, n_blocks: int, order: int, least: int, bits: int) -> DataFrame:
    """Corpus counts of the longer n-grams, back to every block that has them, like those of the words.

    ``totals`` are zero below ``least``, else twice the count, and one more in one block of each n-gram: there it is listed.
    """
    cuts = first_cuts(n_blocks, bits)

    def dealt(batches):
        for b in batches:
            for block, hashes, tokens, ends, marks in zip(*(b.column(c).to_pylist() for c in ("block", "hashes", "tokens", "ends", "marks"))):
                ends = unpacked(ends, "<i8")
                grams = Grams.of(unpacked(hashes, "<u8"), unpacked(tokens, "<u4"), ends, order)
                learnt = np.repeat(unpacked(marks, "u1") & 1 == 0, np.diff(ends, prepend=0))
                times = sum(np.bincount(number[learnt[spot]], minlength=len(grams.keys)) for spot, number in grams.at)
                yield sliced(block, grams.keys, times.astype(np.uint32), cuts)

    slices = packs.select("block", "hashes", "tokens", "ends", "marks").mapInArrow(dealt, SLICES)
    return written(looked_up(slices, n_blocks, "<u4", lambda sums: np.where(sums >= least, 2 * sums + 1, 0), True, bits), "lm-grams")


def parts(own: pd.DataFrame, kind: str, dtype: str) -> np.ndarray:
    """The answers of one kind to a block, in the order of its sorted hashes."""
    rows = own[own["kind"] == kind].sort_values("node")["totals"]
    return np.concatenate([np.empty(0, dtype), *[unpacked(x, dtype) for x in rows]])


def contexts(hashes: np.ndarray, words: np.ndarray, grams: Grams, value: np.ndarray, order: int, least: int) -> np.ndarray:
    """Sorted hashes of the n-grams of a block that kept longer n-grams may begin with."""
    return np.sort(np.r_[hashes[words >= least], grams.keys[(value > 0) & (grams.size < order)]])


def spent(packs: DataFrame, answers: DataFrame, n_blocks: int, order: int, least: int, bits: int) -> DataFrame:
    """What the kept continuations of a context take of its count, sum of c - D, back to every block that has the context.

    Counts are added up from the blocks' own occurrences; the discount is taken once, where the n-gram is listed.
    """
    cuts = first_cuts(n_blocks, bits)

    def dealt(pack: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pack):
            return pd.DataFrame({c: [] for c in ("node", "source", "hashes", "counts")})
        row = pack.iloc[0]
        hashes, ends = unpacked(row["hashes"], "<u8"), unpacked(row["ends"], "<i8")
        grams, value = Grams.of(hashes, unpacked(row["tokens"], "<u4"), ends, order), parts(own, "gram", "<i8")
        asked = contexts(hashes, parts(own, "word", "<i8"), grams, value, order, least)
        learnt = np.repeat(unpacked(row["marks"], "u1") & 1 == 0, np.diff(ends, prepend=0))
        times = sum(np.bincount(number[learnt[spot]], minlength=len(grams.keys)) for spot, number in grams.at)
        kept = np.flatnonzero(value)
        taken = np.bincount(np.searchsorted(asked, grams.before[kept]), weights=times[kept] - DISCOUNT * (value[kept] & 1), minlength=len(asked))
        return sliced(int(row["block"]), asked, taken, cuts).to_pandas()

    slices = packs.select("block", "hashes", "tokens", "ends", "marks").groupBy("block").cogroup(answers.groupBy("source")).applyInPandas(dealt, SLICES)
    return written(looked_up(slices, n_blocks, "<f8", lambda sums: sums, bits=bits), "lm-spent")


@dataclass
class Automaton:
    """The states of a block and what their arcs weigh, laid out by the places of its tokens.

    A state is a context: the empty one (order 0), a word (1), a kept n-gram of two words or more (its length). ``arcs[k]``
    has for each place the log10 weight of the arc that its word takes from the state of order ``k`` before it, or
    ``NO_ARC``; every word has an arc from the empty context. ``fails[k]`` has the log10 weight of that state's failure arc,
    which leads to the state without its first word. An arc from a state of order ``k`` ends in the state of order ``k + 1``,
    or of the highest order there is: the longest context that the words read so far end in.
    """

    arcs: list[np.ndarray]
    fails: list[np.ndarray]

    @classmethod
    def of(cls, hashes: np.ndarray, tokens: np.ndarray, ends: np.ndarray, single: np.ndarray, total: np.ndarray, answers: pd.DataFrame, order: int, least: int) -> "Automaton":
        """From the corpus counts that came back to the block. Interpolated absolute discounting:

        P(w | h) = (c(hw) - D) / c(h) + rest(h) P(w | shorter h) on the arc of a kept n-gram, rest(h) on the failure arc,
        with rest(h) = 1 - sum of (c - D) over the kept continuations of h, by c(h).
        """
        arcs, fails = [np.log10(single)[tokens]], [np.zeros(len(tokens))]
        if order < 2:
            return cls(arcs, fails)
        grams, value = Grams.of(hashes, tokens, ends, order), parts(answers, "gram", "<i8")
        asked, taken = contexts(hashes, total, grams, value, order, least), parts(answers, "spent", "<f8")

        def used(keys: np.ndarray) -> np.ndarray:
            """What the kept continuations of contexts take of their counts."""
            at = np.minimum(np.searchsorted(asked, keys), max(len(asked) - 1, 0))
            return np.where(asked[at] == keys, taken[at], 0.0) if len(asked) else np.zeros(len(keys))

        longer = np.flatnonzero((value > 0) & (grams.size < order))
        spent_by = np.zeros(len(value))
        spent_by[longer] = used(grams.keys[longer])
        spots = grams.at
        del grams, longer
        value >>= 1
        # Of the context that ends at each place: count, what is taken of it; and the chance of the arc that ended there.
        count, spent_of, chance = total[tokens], used(hashes)[tokens], single[tokens]
        for k, (places, number) in enumerate(spots, 2):
            whole, times = np.maximum(count[places - 1], 1), value[number]
            rest = 1 - spent_of[places - 1] / whole
            kept = times > 0
            at = places[kept]
            own = (times[kept] - DISCOUNT) / whole[kept] + rest[kept] * chance[at]
            del whole
            arc, fail = np.full(len(tokens), NO_ARC), np.zeros(len(tokens))
            arc[at] = np.log10(own)
            fail[places] = np.log10(rest)
            arcs.append(arc)
            fails.append(fail)
            if k < order:
                count, spent_of = np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
                count[places], spent_of[places], chance[at] = times, spent_by[number], own
        return cls(arcs, fails)

    def walk(self, ends: np.ndarray) -> np.ndarray:
        """Log10 probability of every text, from left to right, many places at a time.

        Of a kept n-gram what it ends in is kept too, so a state has an arc only if the shorter ones have: after a place the order is k or
        more if it was k - 1 or more before and there was an arc from order k - 1. Weights are added one by one, failure arcs first.
        """
        top, n, firsts = len(self.arcs) - 1, len(self.arcs[0]), np.r_[0, ends[:-1]]
        state, before = np.zeros(n, np.int8), np.ones(n, bool)
        for k in range(top):
            after = before & (self.arcs[k] <= 0)
            before = np.r_[False, after[:-1]]
            before[firsts] = False
            state += before
        out, text, total = np.empty(len(ends)), 0, 0.0
        for first in range(0, n, WALK):
            own = slice(first, min(first + WALK, n))
            steps, done = np.zeros((own.stop - first, top + 1)), np.zeros(own.stop - first, bool)
            for k in range(top, -1, -1):
                at = ~done & (state[own] >= k)
                taken = at & (self.arcs[k][own] <= 0)
                steps[:, top - k] = np.where(taken, self.arcs[k][own], np.where(at, self.fails[k][own], 0.0))
                done |= taken
            begin = first
            while begin < own.stop:
                end = min(int(ends[text]), own.stop)
                weights = steps[begin - first : end - first].ravel()
                weights[0] += total
                total, begin = float(np.add.accumulate(weights)[-1]), end
                if end == ends[text]:
                    out[text], text, total = total, text + 1, 0.0
        return out


def score(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from the rows where ``held`` is not true. Words are A-Z lower-cased runs between blanks, with one end
    token per text; null and empty texts have the end only. The unigram model covers all words. All longer n-grams that occur
    ``least`` times are kept, however large the corpus; no task or driver has them all: each block of texts gets the counts of
    its own words and n-grams (:mod:`exchange`, ``bits`` are its), builds its states, arcs and failure arcs from them, and walks
    its texts from left to right. Texts are read whole; one text is never split, so memory grows with the longest. Ids are whole numbers. Repeated rows are scored (and counted) each time; rows
    with a null id learn. An empty table gives an empty one; other columns are not read.
    """
    packs = blocks(docs, doc_id, text, held)
    n, n_blocks = packs.agg(F.sum("n_train"), F.count(F.lit(1))).first()
    n = n or 0
    word_rows = totals(packs, n_blocks, bits)
    types = word_rows.agg(F.sum("types")).first()[0] or 0
    of_kind = lambda rows, kind: rows.select("source", "node", "totals", F.lit(kind).alias("kind"))
    answers = of_kind(word_rows, "word")
    if order > 1:
        answers = answers.unionByName(of_kind(gram_totals(packs, n_blocks, order, least, bits), "gram"))
        answers = answers.unionByName(of_kind(spent(packs, answers, n_blocks, order, least, bits), "spent"))

    def scored(pack: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pack):
            return pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")})
        row = pack.iloc[0]
        hashes, tokens, ends = unpacked(row["hashes"], "<u8"), unpacked(row["tokens"], "<u4"), unpacked(row["ends"], "<i8")
        total, first = parts(own, "word", "<i8"), np.r_[0, ends[:-1]]
        single = (total + ADD) / (n + ADD * (types + 1))
        base = np.add.reduceat(np.log10(single)[tokens], first)
        model = Automaton.of(hashes, tokens, ends, single, total, own, order, least)
        marks = unpacked(row["marks"], "u1")
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(unpacked(row["ids"], "<i8").copy(), marks & 2 > 0), "held_out": marks & 1 > 0, "n_tokens": ends - first,
            "n_known": np.add.reduceat((total > 0).astype(np.int64)[tokens], first), "base_score": base, "score": model.walk(ends),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    rows = packs.drop("counts", "n_train").groupBy("block").cogroup(answers.groupBy("source")).applyInPandas(scored, schema)
    return rows.withColumn("train_tokens", F.lit(n).cast("long"))
