"""Append-only tables of detections, alerts, reviewer decisions, feedback, training runs and signatures."""

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens import schema
from trafficlens.sources.folders import Folders


def _event_time(name: str) -> str:
    return "decided_at" if name == "alert_decisions" else "timestamp"


class Store:
    """Tables below one folder. Rows are never changed in place: readers resolve the latest state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folders = spark, path.rstrip("/"), Folders(spark)

    def location(self, name: str) -> str:
        return f"{self.path}/{name}"

    def create_tables(self, database: str = "default", prefix: str = "") -> None:
        """Register every table in the catalog if it is not there yet."""
        for name, columns in schema.TABLES.items():
            by_day = ", `dt` date" if name in schema.DAY_PARTITIONED else ""
            clause = " PARTITIONED BY (`dt`)" if by_day else ""
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {database}.{prefix}{name} ({schema.ddl(columns)}{by_day}) USING parquet{clause} "
                f"LOCATION '{self.location(name)}'"
            )

    def drop_tables(self, database: str = "default", prefix: str = "") -> None:
        """Take the tables out of the catalog; their files stay."""
        for name in schema.TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {database}.{prefix}{name}")

    def has_batch(self, name: str, batch: str) -> bool:
        """Whether a stream batch was appended. A write shows all its rows or none, and files keep the range of ``batch``, so few are read."""
        try:
            stored = self.spark.read.schema("batch string").parquet(self.location(name))
        except AnalysisException:  # no table yet
            return False
        return not stored.filter(F.col("batch") == batch).isEmpty()

    def _mark(self, name: str, batch: str, state: str) -> str:
        return f"{self.path}/_batches/{name}/{state}/{batch.replace(':', '/')}"

    def append(self, name: str, rows: DataFrame, batch: str | None = None) -> None:
        """Append rows in the layout of the table; missing columns become NULL.

        ``batch`` names a stream batch (``writer:number``): a batch whose rows are there is not appended again. An empty file
        tells that it was written, another one that its write began; the rows themselves are only looked for where a write
        began and did not end. So the time per batch does not grow with the table.
        """
        if batch is not None:
            begun, done = (self._mark(name, batch, state) for state in ("begun", "done"))
            if self.folders.exists(done):
                return
            if self.folders.exists(begun) and self.has_batch(name, batch):
                self.folders.mark(done)
                return
            self.folders.mark(begun)
        have = set(rows.columns)
        rows = rows.select(
            *[
                (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
                for c, kind in schema.TABLES[name].items()
            ],
            *([F.lit(batch).alias("batch")] if batch is not None else []),
        )
        if name in schema.DAY_PARTITIONED:
            # Rebalancing by day avoids one file per task and day, and splits a day that is too large.
            rows = rows.withColumn("dt", F.to_date(_event_time(name))).hint("rebalance", "dt")
            rows.write.mode("append").partitionBy("dt").parquet(self.location(name))
        else:
            rows.write.mode("append").parquet(self.location(name))
        if batch is not None:
            self.folders.mark(done)
            self.folders.remove(begun)

    def append_training(self, runs: DataFrame) -> None:
        """Append training runs; a missing metric counts as 0."""
        metrics = ("accuracy", "precision", "recall", "f1_score", "false_positive_rate", "training_time")
        have = set(runs.columns)
        for m in metrics:
            runs = runs.withColumn(m, F.coalesce(F.col(m) if m in have else F.lit(None).cast("double"), F.lit(0.0)))
        self.append("training_history", runs)

    def horizons(self, name: str) -> list[str]:
        """Days before which rows were dropped, oldest call first."""
        return self.folders.names(f"{self.path}/_horizons/{name}")

    def drop_days(self, name: str, before: str) -> list[str]:
        """Drop the days of a table before a day (``2024-01-31``); returns the folders removed.

        The new horizon is one empty file, so for readers that start later all those days are gone at once, or none is.
        Their files go at the next call: readers that had started before keep them until then. A horizon never moves back.
        """
        if name not in schema.DAY_PARTITIONED:
            raise ValueError(f"{name} is not stored by day")
        known = self.horizons(name)
        gone = [d for d in self.folders.names(self.location(name)) if known and d.startswith("dt=") and d.removeprefix("dt=") < known[-1]]
        for d in gone:
            self.folders.remove(f"{self.location(name)}/{d}")
        self.folders.mark(f"{self.path}/_horizons/{name}/{datetime.date.fromisoformat(before)}")
        for h in known[:-1]:
            self.folders.remove(f"{self.path}/_horizons/{name}/{h}")
        return gone

    def read(self, name: str) -> DataFrame:
        """Rows of a table; by day, those from the newest horizon on."""
        if name not in schema.DAY_PARTITIONED:
            return self.spark.read.schema(schema.ddl(schema.TABLES[name])).parquet(self.location(name))
        rows = self.spark.read.schema(schema.ddl(schema.TABLES[name] | {"dt": "date"})).parquet(self.location(name))
        known = self.horizons(name)
        # A row without a time lies in no day and stays.
        return rows.filter((F.col("dt") >= F.lit(known[-1]).cast("date")) | F.col("dt").isNull()) if known else rows
