"""Session settings and the shared working folder."""

import uuid

from pyspark.sql import SparkSession


def build_session(app: str, master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the submitter owns the session."""
    builder = (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Session windows merge rows of a key before the shuffle, so a hot pair does not send every packet to one task.
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else a folder below the warehouse, which Spark shares too.

    A cluster must name the former; only a purely local session falls back to the latter.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_working"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh, never reused folder below the shared one."""
    return f"{shared_folder(spark)}/trafficlens/{purpose}-{uuid.uuid4().hex}"
