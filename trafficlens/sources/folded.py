"""Logs that are read folded: a snapshot up to a position, and the entries behind it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.sources.folders import Folders

DIGITS = 12


class FoldedLog:
    """Entries appended at numbered positions, and what they fold to.

    ``fold`` turns entries into their result in the same columns, such that folding parts first changes nothing: sums per
    key, the newest entry per key, the newest n rows. A position is one folder; it counts from the moment its write is
    complete (Spark's success marker), and writing it again replaces it, so a replayed batch changes nothing. :meth:`compact`
    writes the fold of everything so far as a snapshot. Readers take the newest complete snapshot and the positions behind
    it. Folders that a snapshot replaces are removed at the next compaction, so running readers keep theirs. One writer at
    a time appends and compacts; any number may read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, fold: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.fold, self.folders = spark, path.rstrip("/"), schema, fold, Folders(spark)

    def _folder(self, kind: str, position: int) -> str:
        return f"{self.path}/{kind}-{position:0{DIGITS}d}"

    def _positions(self, kind: str) -> list[int]:
        found = [int(n.removeprefix(kind + "-")) for n in self.folders.names(self.path) if n.startswith(kind + "-")]
        return [p for p in found if self.folders.exists(self._folder(kind, p) + "/_SUCCESS")]

    @property
    def snapshot(self) -> int:
        """Position of the newest snapshot, -1 without one."""
        return max(self._positions("snapshot"), default=-1)

    @property
    def tail(self) -> list[int]:
        """Positions behind the snapshot."""
        return sorted(p for p in self._positions("entries") if p > self.snapshot)

    def append(self, rows: DataFrame, position: int | None = None) -> int:
        """Write entries at ``position`` (the next one where it is not given); a position within the snapshot is left alone."""
        upto = self.snapshot
        if position is None:
            position = max([upto, *self._positions("entries")]) + 1
        if position > upto:
            names = [c.split()[0] for c in self.schema.split(", ")]
            rows.select(*names).write.mode("overwrite").parquet(self._folder("entries", position))
        return position

    def folders_read(self, upto: int | None = None) -> list[str]:
        """What a reader touches: the snapshot and the tail."""
        base = self.snapshot
        kept = [p for p in self.tail if upto is None or p <= upto]
        return ([self._folder("snapshot", base)] if base >= 0 else []) + [self._folder("entries", p) for p in kept]

    def entries(self, upto: int | None = None) -> DataFrame:
        """Rows of the snapshot and of the tail, not folded."""
        paths = self.folders_read(upto)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self.fold(self.entries())

    def compact(self) -> int:
        """Fold snapshot and tail into a new snapshot; returns its position. Removes what the snapshot before replaced."""
        before, tail = self.snapshot, self.tail
        if not tail:
            return before
        upto = tail[-1]
        old = [self._folder(k, p) for k in ("snapshot", "entries") for p in self._positions(k) if (p < before if k == "snapshot" else p <= before)]
        self.fold(self.entries(upto)).write.mode("overwrite").parquet(self._folder("snapshot", upto))
        for path in old:
            self.folders.remove(path)
        return upto


def sums(keys: list[str], values: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def newest_per(key: str, order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Of each key the entry that comes last by ``order``, whole."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != key]
        return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_e")).select(key, "_e.*").select(*rows.columns)

    return fold


def newest_rows(n: int, order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """The ``n`` rows that come last by ``order``."""
    return lambda rows: rows.orderBy(*[F.desc(c) for c in order]).limit(n)
