"""Exact ranks, cuts and samples without sorting a whole group in one task."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def seeded_key(id_column: str, seed: int) -> Column:
    """Pseudo-random but reproducible hexadecimal key of a row; rows without an id share one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))


def _bucketed(df: DataFrame, id_column: str, seed: int, digits: int) -> DataFrame:
    return df.withColumn("_key", seeded_key(id_column, seed)).withColumn("_bucket", F.substring("_key", 1, digits))


def _offsets(keyed: DataFrame, groups: list[str]) -> DataFrame:
    """Per group (``_g_`` columns) and bucket ``_b``: its rows ``_n``, the rows before it ``_offset``, and ``group_size``."""
    sizes = keyed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*groups)
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_bucket").alias("_b"), "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(whole).alias("group_size"),
    )


def seeded_rank(df: DataFrame, id_column: str, seed: int, group: str | None = None, digits: int = 4) -> DataFrame:
    """Add ``rank`` (1..n) and ``group_size`` of each row in seeded order, per group.

    The key is uniform, so its first ``digits`` hexadecimal digits cut every group, however large, into
    16**digits even buckets. Rows are ranked inside their bucket and shifted by the size of the buckets
    before it; only bucket sizes are ever ordered per group.
    """
    groups = [group] if group else []
    keyed = _bucketed(df, id_column, seed, digits)
    same = [F.col("_bucket") == F.col("_b"), *[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]]
    inside = W.partitionBy(*groups, "_bucket").orderBy("_key", id_column)
    ranked = keyed.withColumn("_rn", F.row_number().over(inside)).join(_offsets(keyed, groups).drop("_n"), same)
    return ranked.withColumn("rank", F.col("_rn") + F.col("_offset")).drop(
        "_key", "_bucket", "_b", "_rn", "_offset", *[f"_g_{g}" for g in groups]
    )


# Cut points of at most so many groups are broadcast; more of them are joined by shuffle.
MOST_GROUPS = 100_000


def _bounded(points: DataFrame) -> tuple[list | None, DataFrame]:
    """One row per group: collected rows and the table made of them to be broadcast, or no rows and the table as it is."""
    few = points.limit(MOST_GROUPS + 1).collect()
    if len(few) > MOST_GROUPS:
        return None, points
    return few, F.broadcast(points.sparkSession.createDataFrame(few, points.schema))


def _at_groups(df: DataFrame, few: list | None, points: DataFrame, groups: list[str]) -> DataFrame:
    """Rows with the point of their group, if any; the point of an ungrouped table becomes constants."""
    if not groups:
        return df.withColumns({f.name: F.lit(few[0][f.name] if few else None).cast(f.dataType) for f in points.schema.fields})
    return df.join(points, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups], "left").drop(*[f"_g_{g}" for g in groups])


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), conditions, F.lit(False))


def seeded_pieces(df: DataFrame, id_column: str, seed: int, cuts: list[Column], group: str | None = None, digits: int = 4) -> DataFrame:
    """Add ``piece``: how many of ``cuts`` (ranks, as expressions of ``group_size``) lie before the row in seeded order.

    Bucket sizes tell in which bucket a cut falls; the keys of that bucket, counted, tell the very key. Both passes read
    the id and the group only. Every row is then decided in place by comparing its key, so no row is shuffled. Rows of
    one key (a repeated id, or no id) have no order among them: only where a cut falls between such rows are they numbered.
    """
    groups = [group] if group else []
    inner = range(len(cuts))
    narrow = _bucketed(df.select(*dict.fromkeys([*groups, id_column])), id_column, seed, digits).drop(*{id_column} - set(groups))
    at = _offsets(narrow, groups).withColumns({f"_c{i}": c.cast("bigint") for i, c in enumerate(cuts)})
    holds = [(F.col(f"_c{i}") > F.col("_offset")) & (F.col(f"_c{i}") <= F.col("_offset") + F.col("_n")) for i in inner]
    each_group = [f"_g_{g}" for g in groups]
    found = at.groupBy(*each_group).agg(
        *[F.max(F.when(h, F.col("_b"))).alias(f"_b{i}") for i, h in enumerate(holds)],
        *[F.max(F.when(h, F.col(f"_c{i}") - F.col("_offset"))).alias(f"_r{i}") for i, h in enumerate(holds)],
        *[F.max(F.col(f"_c{i}") >= F.col("group_size")).alias(f"_all{i}") for i in inner],
    )
    few, buckets = _bounded(found)
    in_cut = _at_groups(narrow, few, buckets, groups).filter(_any([F.col("_bucket") == F.col(f"_b{i}") for i in inner]))
    marks = [f"{n}{i}" for n in ("_b", "_r", "_all") for i in inner]
    counted = in_cut.groupBy(*groups, "_bucket", "_key", *marks).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*groups, "_bucket").orderBy("_key"))
    keys = counted.withColumn("_upto", upto)
    cut_key = [(F.col("_bucket") == F.col(f"_b{i}")) & (F.col(f"_r{i}") <= F.col("_upto")) & (F.col(f"_r{i}") > F.col("_upto") - F.col("_n")) for i in inner]
    exact = keys.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, each_group)]).agg(
        *[F.max(F.when(c, F.col("_key"))).alias(f"_k{i}") for i, c in enumerate(cut_key)],
        *[F.max(F.when(c & (F.col(f"_r{i}") < F.col("_upto")), F.col(f"_r{i}") - F.col("_upto") + F.col("_n"))).alias(f"_t{i}") for i, c in enumerate(cut_key)],
    )
    ends = _at_groups(df.withColumn("_key", seeded_key(id_column, seed)), few, buckets, groups)
    few, points = _bounded(exact)
    keyed = _at_groups(ends, few, points, groups)

    def piece(number: Column) -> Column:
        """A cut beyond the group has no row behind it; one without a key lies before all rows."""
        past = [
            F.when(F.col(f"_all{i}"), 0).when(F.col(f"_k{i}").isNull() | (F.col("_key") > F.col(f"_k{i}")), 1).when(F.col("_key") < F.col(f"_k{i}"), 0)
            .otherwise(F.coalesce((number > F.col(f"_t{i}")).cast("int"), F.lit(0))) for i in inner
        ]
        return sum(past, F.lit(0))

    if few is not None and all(r[f"_t{i}"] is None for r in few for i in inner):
        both = keyed.withColumn("piece", piece(F.lit(0)))
    else:
        between = _any([F.col(f"_t{i}").isNotNull() & (F.col("_key") == F.col(f"_k{i}")) for i in inner])
        numbered = keyed.filter(between).withColumn("_rn", F.row_number().over(W.partitionBy(*groups, "_key").orderBy(id_column)))
        both = keyed.filter(~between).withColumn("piece", piece(F.lit(0))).unionByName(numbered.withColumn("piece", piece(F.col("_rn"))).drop("_rn"))
    return both.drop("_key", *marks, *[f"{n}{i}" for n in ("_k", "_t") for i in inner])


def seeded_sample(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), the same on every run."""
    return seeded_pieces(df, id_column, seed, [F.lit(n)]).filter("piece = 0").drop("piece")


def newest(df: DataFrame, n: int, offset: int = 0, ts: str = "timestamp", key: str = "id") -> DataFrame:
    """Page of the newest rows; ties are ordered by key, newest key first. Pages are for display: offset + n rows meet in one task."""
    page = df.orderBy(F.desc(ts), F.desc(key))
    return (page.offset(offset) if offset else page).limit(n)
