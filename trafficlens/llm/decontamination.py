"""Benchmark decontamination: prefix-filtered set join of benchmark windows and document shingles, in built-in functions only."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import ascii_lower, let, written

WIDTH = 10
SHINGLE = 3
# Benchmark shingles sent to every executor at once (16 bytes each); more of them go in further passes over the documents.
MOST_KEYS = 1_000_000


def words(text: Column) -> Column:
    """A-Z lower-cased runs of digits, letters and everything beyond ASCII; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def windows(benchmark: DataFrame, width: int = WIDTH, text: str = "text", item: str = "item_id") -> DataFrame:
    """Distinct ``window`` (array of words), its ``len`` and ``items`` (ids as strings; a null id is the empty string)."""
    each = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    cut = each.select("item", "w", F.explode(starts).alias("start")).select("item", F.slice("w", F.col("start"), width).alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("window"))


def shingle_key(w, i: Column, q: int) -> Column:
    return F.xxhash64(F.lit(q), *[F.get(w, i + k) for k in range(q)])


def shingles(wins: DataFrame, q: int) -> DataFrame:
    """``window``, ``offset`` and ``key`` of every shingle of the windows that have shingles of ``q`` words."""
    own = wins.filter(F.least(F.col("len"), F.lit(SHINGLE)) == q)
    return own.select("window", "items", "len", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("len") - q), lambda i: shingle_key(F.col("window"), i, q))).alias("offset", "key"))


def hits(rows: DataFrame, keys: DataFrame, q: int, width: int) -> DataFrame:
    """Positions whose shingle is a benchmark shingle, with the words around them; position -1 stands for the row itself."""
    at = rows.select("row", "w", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("at", "_")).select("row", "w", (F.col("at") - 1).alias("pos"))
    keyed = at.withColumn("key", F.when((F.col("pos") >= 0) & (F.col("pos") + q <= F.size("w")), shingle_key(F.col("w"), F.col("pos"), q)))
    met = keyed.join(F.broadcast(keys.withColumn("met", F.lit(True))), "key", "left").filter("pos < 0 or met")
    first = F.greatest(F.col("pos") - (width - q), F.lit(0))
    return met.select(
        "row", "pos", "key", F.size("w").alias("n_words"), first.alias("first"),
        F.when(F.col("pos") >= 0, F.slice("w", first + 1, F.lit(2 * width - q))).alias("around"),
    )


def overlaps(rows: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per ``row`` of (row, text): ``n_words``, ``n_hit`` (words inside an occurring window) and ``items`` whose windows occur.

    A window occurs exactly where all its shingles do, so one necessary shingle, its rarest in the documents, is enough to
    find the candidates; the shingle's offset gives the start, which must leave room for the window's length, and then
    the words are compared. One pass over the documents finds the occurrences of benchmark shingles; counts, prefixes and
    candidates come from that small table. Shingles are broadcast up to a checked number and in further passes beyond it.
    ``row`` must be unique; it may be a struct that carries more. Null texts have no words; benchmark items without words have no window.
    """
    wins = written(windows(benchmark, width), "bench-windows")
    sizes = sorted(r[0] for r in wins.select(F.least("len", F.lit(SHINGLE))).distinct().collect())  # three values at most
    base = rows.select("row", words(F.col("text")).alias("w"))
    total = {q: shingles(wins, q).select("key").distinct().count() for q in sizes}
    passes = [(q, -(-n // MOST_KEYS), k) for q, n in total.items() for k in range(-(-n // MOST_KEYS))]
    if len(passes) > 1:
        base = written(base, "bench-words")
    found = [hits(base, shingles(wins, q).filter(F.pmod("key", F.lit(n)) == k).select("key").distinct(), q, width) for q, n, k in passes]
    if not found:
        return rows.select("row", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    met = written(reduce(DataFrame.unionByName, found), "bench-hits")
    often = met.filter("pos >= 0").groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    every = reduce(DataFrame.unionByName, [shingles(wins, q) for q in sizes])
    # Windows with a shingle that no document has are gone here: the rarest shingle must be found.
    ranked = every.join(often, "key", "left").groupBy("window", "items", "len").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "offset", "key")).alias("rarest"))
    prefix = ranked.filter("rarest.often > 0").select("window", "items", "len", F.col("rarest.offset").alias("offset"), F.col("rarest.key").alias("key"))
    start = F.col("pos") - F.col("offset")
    holds = (
        (F.col("m.key") == F.col("p.key")) & (start >= 0) & (start + F.col("len") <= F.col("n_words"))
        & (F.slice("around", F.greatest(start - F.col("first") + 1, F.lit(1)), F.col("len")) == F.col("window"))
    )
    occurring = met.filter("pos >= 0").alias("m").join(prefix.alias("p"), holds).select("row", start.alias("start"), (start + F.col("len")).alias("end"), "items")
    grow = lambda acc, s: F.struct(
        (acc["covered"] + F.greatest(s["end"] - F.greatest(s["start"], acc["reach"]), F.lit(0))).alias("covered"), F.greatest(acc["reach"], s["end"]).alias("reach")
    )
    union = F.aggregate(F.sort_array("spans"), F.struct(F.lit(0).alias("covered"), F.lit(0).alias("reach")), grow)
    per_row = (
        occurring.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
        .select("row", union["covered"].cast("long").alias("n_hit"), F.sort_array(F.array_distinct("items")).alias("items"))
    )
    counted = met.filter("pos < 0").select("row", F.col("n_words").cast("long").alias("n_words"))
    counted = counted if len(found) == 1 else counted.distinct()  # every pass has each row
    return counted.join(per_row, "row", "left").select(
        "row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def rows_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (unique), ``doc`` (struct of the input row) and ``text``, from a written table, so that the row numbers stay."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "bench-rows").withColumn("text", F.col(f"doc.{text}"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """The input rows that share no window with the benchmark, columns unchanged; null and empty texts stay."""
    rows = rows_of(docs, text)
    bad = overlaps(rows, benchmark, width).filter("n_hit > 0").select("row")
    return rows.join(bad, "row", "left_anti").select("doc.*")
