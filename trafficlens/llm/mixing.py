"""Mixing sources to target weights by systematic sampling."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trafficlens.llm.common import words, written

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def positions(sources: DataFrame) -> DataFrame:
    """``sources`` with ``position`` (0, 1, …) in code-point order, null last. Sorted by range; only sizes of partitions meet in one task."""
    placed = written(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id()), "mixing-sources")
    part = placed.withColumn("_part", F.shiftright("_id", 33))
    before = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    return part.join(before, "_part").withColumn("position", F.col("_before") + F.col("_id") % (1 << 33)).drop("_id", "_part", "_before")


def level(sources: DataFrame) -> float:
    """Words per unit of weight once the targets above ``MOST_COPIES`` sizes are cut and the excess is shared again by weight."""
    cap = F.col("source_size") * MOST_COPIES
    at = None
    while True:
        cut = F.lit(False) if at is None else cap < F.col("weight") * F.lit(at)
        total, taken, weight = sources.agg(F.sum("source_size"), F.sum(F.when(cut, cap).otherwise(0)), F.sum(F.when(cut, 0).otherwise(F.col("weight")))).first()
        now = (total - taken) / weight if weight else at or 0.0
        if now == at:
            return now
        at = now


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: ``skey`` (never null), ``source_size``, ``target``, ``rate`` (expected copies), ``offset`` in [0, 1)."""
    sources = written(positions(docs.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))).withColumn("weight", weight_of(F.col("position"), weights)), "mixing-weights")
    share = F.least(F.col("weight") * F.lit(float(level(sources))), (F.col("source_size") * MOST_COPIES).cast("double"))
    return sources.select(
        "skey", "source_size", share.alias("target"),
        F.when(F.col("source_size") > 0, share / F.col("source_size")).otherwise(0.0).alias("rate"),
        (F.conv(F.substring(F.md5("skey"), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)).alias("offset"),
    )


def weight_of(position: Column, weights: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, weights)), (position % len(weights)).cast("int") + 1)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``doc`` (struct of the input row), ``size``, ``source_size``, ``target``, ``copies`` (0 to 3).

    Every document expects target / size copies of its source. Their prefix sums within the source, in order of size, plus
    one offset per source decide: one copy per integer crossed. Ordering by size spreads the copies evenly over short
    and long texts, so a source misses its target by about one document at most.

    The prefix sum is a rank: cells (source, size, hash of the id) are counted, cells are added up within a size and sizes
    within a source, and rows are ranked inside their cell only, so neither a hot source nor many equal texts meet in one task.
    Null texts have size 0; a null source is a source of its own; a null id is replaced by the text. Rows of one source, size
    and id are ranked by a hash of id and text, so that reruns agree on any order of the input; repeated rows share a cell and
    are ranked in one task. An empty table gives an empty mix. Other columns are only carried inside ``doc``. A text is split
    into words as a whole, so memory grows with the longest.
    """
    base = docs.select(
        F.struct("*").alias("doc"), F.size(words(F.col(text))).cast("long").alias("size"), F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("skey"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))).alias("key"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("tie"),
    )
    keyed = base.withColumn("bucket", F.substring("key", 1, 3))
    narrow = written(keyed.select("source", "skey", "size", "bucket").groupBy("source", "skey", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "mixing-cells")
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = narrow.groupBy("skey", "size").agg(F.sum("n").alias("n")).select("skey", "size", ahead(W.partitionBy("skey").orderBy("size")).alias("ahead_of_size"))
    shares = targets(narrow.select("source", "skey", (F.col("size") * F.col("n")).alias("size")), weights)
    cells = (
        narrow.select("skey", "size", "bucket", ahead(W.partitionBy("skey", "size").orderBy("bucket")).alias("ahead_of_bucket"))
        .join(sizes, ["skey", "size"]).join(shares, "skey")
        .select("skey", "size", "bucket", (F.col("ahead_of_size") + F.col("ahead_of_bucket")).alias("ahead"), "source_size", "target", "rate", "offset")
    )
    ranked = keyed.withColumn("rank", F.row_number().over(W.partitionBy("skey", "size", "bucket").orderBy("key", "tie"))).join(cells, ["skey", "size", "bucket"])
    upto = F.col("ahead") + F.col("rank")
    crossed = lambda n: F.floor(F.col("rate") * n + F.col("offset"))
    copies = F.least(F.greatest(crossed(upto) - crossed(upto - 1), F.lit(0)), F.lit(MOST_COPIES))
    return ranked.select("doc", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, **columns: str) -> DataFrame:
    """The input rows, each as often as the mix takes it, columns unchanged."""
    taken = mix(docs, weights, **columns).filter("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
