"""User signatures: validation, latest state, and matching against payloads."""

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens import dims, schema
from trafficlens.functions import payload as P
from trafficlens.functions import text as X
from trafficlens.operators import rule_index
from trafficlens.sources import folded
from trafficlens.sources.folded import FoldedLog

# Tests per projected column: enough to share the row, few enough for one plan node.
PATTERNS_PER_COLUMN = 128
# So many signatures at most are tested one by one; both ways give the same rows.
INLINE = 32
# Patterns that require no text: so many at most are tested one by one.
TESTED = 1024


def compiles(pattern: str | None) -> bool:
    """Whether a pattern is valid in byte-regex syntax, in which signatures are written."""
    try:
        re.compile((pattern or "").encode())
        return pattern is not None
    except re.error:
        return False


def bad_patterns(spark: SparkSession, patterns: list[str | None]) -> set[str | None]:
    """Those that do not compile, here or in the engine that will run them. Halves the list where the engine refuses one."""
    bad = {p for p in patterns if not compiles(p)}

    def refused(rest: list[str]) -> set[str]:
        if not rest:
            return set()
        try:
            # A local relation: the engine compiles the patterns while it plans, without a job.
            spark.createDataFrame(pa.table({"p": [P.java_regex(p) for p in rest]})).select(F.rlike(F.lit(""), F.col("p"))).collect()
            return set()
        except Exception as error:  # the JVM reports some patterns as a plain Java error
            if not re.search("PatternSyntaxException|INVALID_PARAMETER_VALUE.PATTERN|regex", str(error)):
                raise
            half = len(rest) // 2
            return refused(rest[:half]) | refused(rest[half:]) if half else set(rest)

    return bad | refused(sorted(set(patterns) - bad))


def checked(additions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) entries of a log of additions. Signatures are settings: their patterns come to the driver to be compiled."""
    patterns = list({r[0] for r in additions.select("pattern").collect()})
    bad = bad_patterns(additions.sparkSession, patterns)
    known = [p for p in bad if p is not None]
    is_bad = F.col("pattern").isNull() | (F.col("pattern").isin(known) if known else F.lit(False))
    return additions.filter(~is_bad), additions.filter(is_bad)


def signature_entry(spark: SparkSession, id: int, name: str, pattern: str, added_at: str, description: str | None = None, category: str = "custom") -> DataFrame:
    """One log entry for :func:`upsert`; a pattern that does not compile is refused."""
    if bad_patterns(spark, [pattern]):
        raise ValueError(f"signature {name!r}: not a valid pattern")
    row = (id, name, pattern, description, category, added_at)
    schema = "id bigint, name string, pattern string, description string, category string, added_at string"
    return spark.createDataFrame([row], schema).withColumn("added_at", F.col("added_at").cast("timestamp"))


def upsert(signatures: DataFrame, additions: DataFrame) -> DataFrame:
    """Apply a log of additions by unique name; entries whose pattern does not compile are left out (see :func:`checked`).

    The newest entry supplies pattern, description and category; the oldest keeps id, active state and
    creation time.
    """
    old = signatures.select(
        "id", "name", "pattern", "description", "category", "is_active", "created_at", "updated_at",
        F.lit(0).alias("_log"),
    )
    new = checked(additions)[0].select(
        "id", "name", "pattern", "description", "category", F.lit(True).alias("is_active"),
        F.col("added_at").alias("created_at"), F.col("added_at").alias("updated_at"), F.lit(1).alias("_log"),
    )
    first, last = F.struct("_log", "created_at", "id"), F.struct("_log", "updated_at", "id")
    merged = old.unionByName(new).groupBy("name").agg(
        F.min_by(F.struct("id", "is_active", "created_at"), first).alias("f"),
        F.max_by(F.struct("pattern", "description", "category", "updated_at"), last).alias("l"),
    )
    return merged.select(
        "f.id", "name", "l.pattern", "l.description", "l.category", "f.is_active", "f.created_at", "l.updated_at"
    )


def log_entries(additions: DataFrame) -> DataFrame:
    """Additions as entries of :func:`signature_log`; those whose pattern does not compile are left out."""
    return checked(additions)[0].select(
        "id", "name", "pattern", "description", "category", F.lit(True).alias("is_active"), F.col("added_at").alias("created_at"), F.col("added_at").alias("updated_at")
    )


def signature_log(spark: SparkSession, path: str) -> FoldedLog:
    """Signatures and additions as one log, read as one row per name as :func:`upsert` gives it; of equal times the larger pattern counts."""

    def fold(rows: DataFrame) -> DataFrame:
        merged = rows.groupBy("name").agg(
            F.min_by(F.struct("id", "is_active", "created_at"), F.struct("created_at", "id")).alias("f"),
            F.max_by(F.struct("pattern", "description", "category", "updated_at"), F.struct("updated_at", "pattern")).alias("l"),
        )
        return merged.select("f.id", "name", "l.pattern", "l.description", "l.category", "f.is_active", "f.created_at", "l.updated_at")

    return FoldedLog(spark, path, schema.ddl(schema.TABLES["dpi_signatures"]).replace("`", ""), fold)


def toggle_log(spark: SparkSession, path: str) -> FoldedLog:
    """Switches of signatures, read as the newest per signature."""
    return FoldedLog(spark, path, "id bigint, is_active boolean, changed_at timestamp", folded.newest_per("id", ["changed_at", "is_active"]))


def toggle(signatures: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (id, is_active, changed_at) entries; the newest per id wins, unknown ids change nothing."""
    latest = changes.groupBy("id").agg(
        F.max_by(F.struct("is_active", "changed_at"), F.struct("changed_at", "is_active")).alias("_c")
    )
    joined = signatures.join(latest, "id", "left")
    return joined.withColumns(
        {
            "is_active": F.coalesce("_c.is_active", "is_active"),
            "updated_at": F.coalesce("_c.changed_at", "updated_at"),
        }
    ).drop("_c")


def delete(signatures: DataFrame, ids: DataFrame) -> DataFrame:
    return signatures.join(ids.select("id"), "id", "left_anti")


def active(signatures: DataFrame) -> DataFrame:
    return signatures.filter("is_active")


def listing(signatures: DataFrame) -> DataFrame:
    return signatures.select("id", "name", "category", X.shorten(F.col("pattern")).alias("pattern"), "is_active")


def builtin(spark: SparkSession) -> DataFrame:
    return dims.literal_rows(spark, "name, pattern", dims.ATTACK_SIGNATURES.items())


def newest_patterns(signatures: DataFrame) -> DataFrame:
    """One pattern per name: the newest where the table has times, of equal ones the largest. Without name or pattern nothing can match."""
    newest = F.struct(*[c for c in ("updated_at", "id") if c in signatures.columns], "pattern")
    return signatures.groupBy("name").agg(F.max(newest)["pattern"].alias("pattern")).filter("name is not null and pattern is not null")


def matches(
    df: DataFrame, signatures: DataFrame | None = None, payload: str = "payload", key: str = "packet_id", include_builtin: bool = True,
) -> DataFrame:
    """(key, signature) for every payload and every signature that matches it.

    A few signatures become literal patterns, tested where the payload lies, without join or shuffle; more than ``INLINE`` are
    looked up by the texts they require (:mod:`rule_index`), so that a payload costs the same however many there are, and stay off the
    driver; patterns that require no text stay literal tests, and beyond ``TESTED`` are joined with every payload. A user signature
    replaces the built-in one of its name.
    """
    text = P.payload_text(F.col(payload), df.schema[payload].dataType)
    rules = newest_patterns(signatures) if signatures is not None else None
    many = rules is not None and signatures.filter("name is not null").select("name").distinct().limit(INLINE + 1).count() > INLINE
    few = rules.collect() if rules is not None and not many else []
    user, replaced, found = {r["name"]: P.java_regex(r["pattern"]) for r in few}, {r["name"] for r in few}, []
    prepared = df.select(key, text.alias("_text")).withColumn("_lower", F.lower("_text"))
    if many:
        index, rest = rule_index.build(rules)
        if include_builtin:
            replaced = {r["name"] for r in rules.filter(F.col("name").isin(list(dims.ATTACK_SIGNATURES))).select("name").collect()}
        user = {r["name"]: r["regex"] for r in rest.limit(TESTED + 1).collect()}
        if len(user) > TESTED:
            user = {}
            found.append(prepared.crossJoin(rest).filter(F.rlike("_text", F.col("regex"))).select(key, F.col("name").alias("signature")))
        if index is not None:
            found.append(rule_index.hits(df, index, key, text))
    tests = {n: t for n, t in P.signature_flags(F.col("_lower")).items() if n not in replaced} if include_builtin else {}
    tests |= {n: F.col("_text").rlike(regex) for n, regex in sorted(user.items())}
    if tests or not found:
        named = [F.when(t, n) for n, t in tests.items()]
        groups = [F.array_compact(F.array(F.lit(None).cast("string"), *named[k : k + PATTERNS_PER_COLUMN])) for k in range(0, max(len(named), 1), PATTERNS_PER_COLUMN)]
        # The outer form keeps Spark from inferring a filter that would run every test a second time.
        found.insert(0, prepared.select(key, F.explode_outer(F.concat(*groups)).alias("signature")).filter("signature is not null"))
    return reduce(DataFrame.unionByName, found)
