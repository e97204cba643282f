"""Token files: raw id payloads in shards, and a minimal perfect hash index from document keys to their place."""

import re
import sys
import types
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trafficlens.llm.common import filesystem, powers, written
from trafficlens.session import new_folder

END = 1
SHARD_BYTES = 32 << 20  # of text
KEYS_PER_BUCKET = 1 << 16
CACHED_BYTES = 128 << 20  # of encoded pieces that a worker process keeps, about
NULL_KEY = 1 << 62


# Kinds of bytes: blank, letter (ASCII, and the bytes of Latin-1 letters), mark (ASCII punctuation but the apostrophe), other.
BLANK, LETTER, MARK, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = BLANK
KINDS[[c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or 0x80 <= c < 0xC0 or c == 0xC3]] = LETTER
KINDS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = MARK
SMALL = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library, remembered per piece.

    This holds for tokenizers that lower-case, drop white space before they merge, part letters from punctuation and mark the
    last id of a word, as ``word_bpe_49k.json`` does; a file whose ids of a probe text differ from those of its pieces is
    refused. A piece is a run of ASCII and Latin-1 letters between blanks, or the punctuation behind it; whatever else
    lies between blanks is one piece. ``ids`` are little-endian unsigned integers of two bytes, four for large vocabularies.
    """

    LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
    PROBE = "The words,  THE Words \t don't\nÜber straße (x2) 漢字 A.B, ×÷, ending!"
    ENTRY = 200  # bytes of a remembered piece beside its own

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.type = id_type(size)
        # Letters between blanks are one word, whose last id is marked as a word's end.
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        # Two halves: when the young one is full it becomes the old one, and what is used again moves back.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0
        if np.frombuffer(self.batch([self.PROBE])[0], self.type).tolist() != self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path}: its ids are not those of the pieces between blanks")

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """The encoder that this worker process keeps between tasks."""
        kept = sys.modules.setdefault("_worker_encoders", types.ModuleType("_worker_encoders"))
        if path not in kept.__dict__:
            kept.__dict__[path] = cls(path)
        return kept.__dict__[path]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Equal pieces are looked up once per batch; the ids are then gathered.

        64-bit hashes gather pieces, their bytes decide: a piece that differs from the first one of its hash is looked up by itself.
        """
        own = [t.encode() for t in texts]
        whole = b" ".join(own)
        raw = np.frombuffer(whole, np.uint8)
        kind = KINDS[raw]
        # Special tokens are found before texts are lower-cased, so where one may be all letters stay.
        if b"<|" not in whole:
            raw = SMALL[raw]
            whole = raw.tobytes()
        start, end = pieces(raw, kind)
        if not len(start):
            return [b""] * len(texts)
        up, down = powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum((raw + np.uint64(1)) * up[:-1])]
            marks = (sums[end] - sums[start]) * down[start]
        del up, down, sums
        _, first, piece = np.unique(marks, return_index=True, return_inverse=True)
        other = differing(raw, start, end, first[piece], kind != BLANK)
        if len(other):
            first, piece = np.r_[first, other], piece.copy()
            piece[other] = np.arange(len(first) - len(other), len(first))
        ids = self.ids([whole[i:j] for i, j in zip(start[first].tolist(), end[first].tolist())])
        sizes = np.array(list(map(len, ids)), np.int64) // np.dtype(self.type).itemsize
        table, begin = np.frombuffer(b"".join(ids), self.type), np.cumsum(sizes) - sizes
        counts = sizes[piece]
        upto = np.r_[0, np.cumsum(counts)]
        gathered = table[np.repeat(begin[piece] - upto[:-1], counts) + np.arange(upto[-1])]
        # A text's first piece is the first that starts at or behind the text's own start.
        edges = upto[np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in own)]))].tolist()
        return [gathered[i:j].tobytes() for i, j in zip(edges, edges[1:])]

    def ids(self, found: list[bytes]) -> list[bytes]:
        """Ids of the pieces, remembered or learnt."""
        if self.size > CACHED_BYTES // 2:
            self.old, self.young, self.size = self.young, {}, 0
        young = self.young
        ids = list(map(young.get, found))
        missing = [k for k, x in enumerate(ids) if x is None]
        again = list(map(self.old.get, [found[k] for k in missing]))
        learnt = self.learn(list({found[k]: None for k, x in zip(missing, again) if x is None}))
        for k, x in zip(missing, again):
            p = found[k]
            young[p] = ids[k] = learnt[p] if x is None else x
            self.size += len(p) + len(ids[k]) + self.ENTRY
        return ids

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        known: dict[bytes, bytes] = {}
        words = [p for p in new if p.isalpha() or p[-1] >= 128 and self.LETTERS.fullmatch(p.decode())]
        for k in range(0, len(words), 256):
            self.learn_words(words[k : k + 256], known)
        rest = [p for p in new if p not in known]
        for k in range(0, len(rest), 4096):
            own = rest[k : k + 4096]
            for p, e in zip(own, self.tokenizer.encode_batch_fast([p.decode() for p in own], add_special_tokens=False)):
                known[p] = np.array(e.ids, self.type).tobytes()
        return known

    def learn_words(self, words: list[bytes], known: dict[bytes, bytes]) -> None:
        """Encode words of letters in one call and cut the ids at the ends of words; if the cuts don't fit, leave them."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.type)
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
        if len(cuts) == len(words):
            raw, cuts = ids.tobytes(), cuts.tolist()
            known.update(zip(words, [raw[i:j] for i, j in zip([0, *cuts], cuts)]))


def pieces(raw: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every piece. What lies between blanks is cut where letters alone are followed by marks alone."""
    cross = np.flatnonzero(raw[:-1] == 0xC3)
    cross = cross[(raw[cross + 1] == 0x97) | (raw[cross + 1] == 0xB7)]  # the signs of multiplication and division are no letters
    kind[cross] = kind[cross + 1] = OTHER
    blank = kind == BLANK
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(start):
        return start, start
    end = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    letter = kind == LETTER
    odd = (kind == OTHER) | letter & np.r_[False, kind[:-1] == MARK]
    simple = letter[start] & ~np.logical_or.reduceat(odd, start)
    cut = start + np.add.reduceat(letter, start, dtype=np.int64)
    cut = cut[simple & (cut < end)]
    return np.sort(np.r_[start, cut]), np.sort(np.r_[end, cut])


def differing(raw: np.ndarray, start: np.ndarray, end: np.ndarray, same_as: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Pieces (``start`` to ``end`` in ``raw``) whose bytes are not those of the piece they are taken for."""
    sizes = end - start
    uneven = sizes != sizes[same_as]
    at = np.flatnonzero(inside)
    wrong = raw[at] != raw[at + np.repeat(np.where(uneven, 0, start[same_as] - start), sizes)]
    return np.flatnonzero(np.logical_or.reduceat(wrong, np.cumsum(sizes) - sizes) | uneven) if wrong.any() else np.flatnonzero(uneven)


def portions(texts: list[str], most: int = 2 << 20):
    """(first, last) of runs of texts with about ``most`` characters."""
    k, size = 0, 0
    for last, t in enumerate(texts, 1):
        size += len(t)
        if size >= most:
            yield k, last
            k, size = last, 0
    if k < len(texts):
        yield k, len(texts)


ANY_BLANK = re.compile("[\x20\x09-\x0d]")


def cut(text: str, most: int = 2 << 20):
    """A text in parts of about ``most`` characters, cut before blanks: no piece lies across them."""
    k = 0
    while len(text) - k > most and (found := ANY_BLANK.search(text, k + most)):
        yield text[k : found.start()]
        k = found.start()
    yield text[k:]


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


@dataclass(frozen=True)
class TokenFiles:
    """Folder of the shards, type of an id, entries (doc_id, occurrence, shard, offset, n_tokens) and index, both tables."""

    folder: str
    type: str
    entries: DataFrame
    index: DataFrame
    buckets: int


def shard_path(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:07d}.bin"


def write(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end: int = END, folder: str | None = None) -> TokenFiles:
    """Encode every text, append ``end`` and write the ids in ascending order of the document id.

    Texts are dealt out by ranges of (id, hash of the text), about ``SHARD_BYTES`` each; a task writes its range as one shard
    under a name of its own and then renames it, so repeated attempts do no harm. Null and empty texts have the
    end id only; null ids come first; rows that repeat an id are numbered by ``occurrence`` in the order of their places.
    Ids are whole numbers. An empty table gives no shard. Columns beside the id and the text are not read. Texts are encoded
    whole, in portions of about two megabytes, longer ones part by part between blanks; their ids lie in memory at once.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    kind = id_type(Tokenizer.from_file(tokenizer).get_vocab_size())
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = plain.withColumn("hash", F.xxhash64("text")).repartitionByRange(max(1, -(-total // SHARD_BYTES)), "doc_id", "hash").sortWithinPartitions("doc_id", "hash")

    def encoded(batches):
        encoder, fs, path, offset, out = None, None, None, 0, None
        shard = TaskContext.get().partitionId()
        for b in batches:
            if out is None:
                encoder, (fs, path) = Encoder.of(tokenizer), filesystem(folder)
                own = f"{path}/attempt-{TaskContext.get().taskAttemptId()}-{shard}"
                out, tail = fs.open_output_stream(own), np.array([end], kind).tobytes()
            counts = []
            texts = b.column("text").to_pylist()
            for k, last in portions(texts):
                found = [b"".join(encoder.batch([x])[0] for x in cut(texts[k]))] if last == k + 1 else encoder.batch(texts[k:last])
                for ids in found:
                    out.write(ids)
                    out.write(tail)
                    counts.append(len(ids) // len(tail) + 1)
            ends = offset + np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(counts), shard)), pa.array(ends - counts), pa.array(np.array(counts, np.int64))], ["doc_id", "shard", "offset", "n_tokens"]
            )
            offset = int(ends[-1]) if counts else offset
        if out is not None:
            out.close()
            fs.move(own, shard_path(path, shard))

    placed = written(ordered.select("doc_id", "text").mapInArrow(encoded, "doc_id long, shard long, offset long, n_tokens long"), "token-places")
    entries = placed.withColumn("occurrence", F.row_number().over(W.partitionBy("doc_id").orderBy("shard", "offset")).cast("long") - 1)
    buckets = max(1, -(-placed.count() // KEYS_PER_BUCKET))
    return TokenFiles(folder, kind, entries, indexed(entries, buckets), buckets)


def keyed(df: DataFrame) -> DataFrame:
    """Adds the index key (id, number) without nulls: a null id is 0 with a number beyond all others."""
    return df.withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("number", F.col("occurrence") + F.when(F.col("doc_id").isNull(), F.lit(NULL_KEY)).otherwise(0))


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return keyed(df).withColumn("bucket", F.pmod(F.xxhash64("id", "number"), F.lit(buckets)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(ids, numbers) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.asarray(ids, np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * mixed(np.asarray(numbers, np.int64).view(np.uint64)))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def level_slots(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(hashes + np.uint64(level + 1) * np.uint64(0xD1342543DE82EF95)) % np.uint64(size)


def perfect_hash(hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels, and the hashes that no level could part. A key sits at its first level where it alone sets a bit."""
    levels: list[np.ndarray] = []
    while len(hashes) and len(levels) < 40:
        slots = level_slots(hashes, len(levels), 2 * len(hashes))
        alone = np.bincount(slots.astype(np.int64), minlength=2 * len(hashes)) == 1
        levels.append(alone)
        hashes = hashes[~alone[slots]]
    return levels, hashes


def places(hashes: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """0 … n-1 for the indexed hashes: set bits before the key's own; -1 where no level has it."""
    out, before, open_ = np.full(len(hashes), -1, np.int64), 0, np.arange(len(hashes))
    for level, bits in enumerate(levels):
        slots = level_slots(hashes[open_], level, len(bits))
        hit = bits[slots]
        ranks = np.cumsum(bits)
        out[open_[hit]] = before + ranks[slots[hit]] - 1
        before, open_ = before + int(ranks[-1]), open_[~hit]
    return out


TABLE = np.dtype([("print", "<u4"), ("shard", "<i8"), ("offset", "<i8"), ("n_tokens", "<i8")])
INDEX_SCHEMA = "bucket long, sizes array<long>, bits binary, places binary, left_ids array<long>, left_numbers array<long>"


def indexed(entries: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: level sizes, their bits, and fingerprint, shard, offset and length in minimal-perfect-hash order."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        hashes = key_hash(group["id"], group["number"])
        levels, rest = perfect_hash(hashes)
        at, n = places(hashes, levels), int(sum(x.sum() for x in levels))
        lost = np.flatnonzero(at < 0)
        at[lost] = n + np.arange(len(lost))  # keys with one and the same hash, kept by name behind the others
        rows = np.zeros(len(group), TABLE)
        for name in ("shard", "offset", "n_tokens"):
            rows[name][at] = group[name].to_numpy()
        rows["print"][at] = fingerprints(hashes)
        bits = np.packbits(np.concatenate(levels)).tobytes() if levels else b""
        return pd.DataFrame({
            "bucket": [group["bucket"].iloc[0]], "sizes": [[len(x) for x in levels]], "bits": [bits], "places": [rows.tobytes()],
            "left_ids": [group["id"].iloc[lost].tolist()], "left_numbers": [group["number"].iloc[lost].tolist()],
        })

    needed = bucketed(entries, buckets).select("bucket", "id", "number", "shard", "offset", "n_tokens")
    return written(needed.groupBy("bucket").applyInPandas(build, INDEX_SCHEMA), "token-index")


def found(block: pd.Series, ids, numbers) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the table, whether the stored fingerprint agrees) for keys of the block's bucket."""
    table = np.frombuffer(block["places"], TABLE)
    sizes = list(block["sizes"])
    bits = np.unpackbits(np.frombuffer(block["bits"], np.uint8))[: sum(sizes)].astype(bool)
    levels = np.split(bits, np.cumsum(sizes)[:-1]) if sizes else []
    hashes = key_hash(ids, numbers)
    at = places(hashes, levels)
    left = {k: len(table) - len(block["left_ids"]) + i for i, k in enumerate(zip(block["left_ids"], block["left_numbers"]))}
    for i in np.flatnonzero(at < 0) if left else ():
        at[i] = left.get((int(ids[i]), int(numbers[i])), -1)
    rows = table[np.maximum(at, 0)]
    return rows, (at >= 0) & (rows["print"] == fingerprints(hashes))


def lookup(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """``doc_id, occurrence, shard, offset, n_tokens`` of (doc_id, occurrence) keys, by the index alone; unknown keys give no row."""
    buckets = files.buckets
    schema = "id long, number long, shard long, offset long, n_tokens long"

    def get(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted) or not len(blocks):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("id", "number", "shard", "offset", "n_tokens")})
        rows, ok = found(blocks.iloc[0], wanted["id"].to_numpy(), wanted["number"].to_numpy())
        return pd.DataFrame({"id": wanted["id"][ok], "number": wanted["number"][ok]} | {c: rows[c][ok] for c in ("shard", "offset", "n_tokens")})

    places = bucketed(keys, buckets).select("bucket", "id", "number").groupBy("bucket").cogroup(files.index.groupBy("bucket")).applyInPandas(get, schema)
    null = F.col("number") >= NULL_KEY
    return places.select(
        F.when(~null, F.col("id")).alias("doc_id"), F.when(null, F.col("number") - NULL_KEY).otherwise(F.col("number")).alias("occurrence"), "shard", "offset", "n_tokens"
    )


def digests(files: TokenFiles, places: DataFrame) -> DataFrame:
    """Adds ``ids_crc32`` over the ids read from the shards, as four-byte little-endian integers. Reads each record at its place."""
    folder, kind = files.folder, files.type

    def read(batches):
        (fs, path), opened, name = filesystem(folder), None, None
        width = np.dtype(kind).itemsize
        for b in batches:
            out = []
            for shard, offset, n in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "n_tokens"))):
                if shard != name:
                    opened, name = fs.open_input_file(shard_path(path, shard)), shard
                ids = np.frombuffer(opened.read_at(n * width, offset * width), kind)
                out.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "occurrence", "shard", "offset", "n_tokens")), pa.array(out, pa.int64())], ["doc_id", "occurrence", "shard", "offset", "n_tokens", "ids_crc32"])

    dealt = places.select("doc_id", "occurrence", "shard", "offset", "n_tokens").repartition("shard").sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(read, "doc_id long, occurrence long, shard long, offset long, n_tokens long, ids_crc32 long")


def shard_starts(files: TokenFiles) -> DataFrame:
    """``shard`` and ``first``, the ids of all shards before it: a running sum over one row per shard."""
    sizes = files.entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return sizes.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))


def read_back(files: TokenFiles, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row of ``docs``, each found through the index and read from its shard."""
    keys = docs.select(F.col(doc_id).cast("long").alias("doc_id")).withColumn("occurrence", F.row_number().over(W.partitionBy("doc_id").orderBy(F.lit(0))).cast("long") - 1)
    rows = digests(files, lookup(files, keys)).join(shard_starts(files), "shard")
    return rows.select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of ``docs`` and read every document back from them."""
    return read_back(write(docs, tokenizer), docs)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

