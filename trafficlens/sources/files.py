"""CSV and JSON files, and the packet stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trafficlens import schema


def read_csv(spark: SparkSession, path: str, table_schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header line. Pass a schema for large inputs: inferring one reads the data twice."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    return reader.csv(path, schema=table_schema) if table_schema else reader.option("inferSchema", True).csv(path)


def read_json(
    spark: SparkSession, path: str, table_schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """JSON lines, or with ``multi_line`` one document per file."""
    return spark.read.option("multiLine", multi_line).json(path, schema=table_schema)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_packet_stream(
    spark: SparkSession, path: str, files_per_trigger: int | None = None,
    table_schema: T.StructType | str = schema.ddl(schema.PACKET), names: str = "*.parquet",
) -> DataFrame:
    """Stream of the Parquet files of a folder whose name fits ``names``.

    ``files_per_trigger`` limits the rate without dropping packets.
    """
    reader = spark.readStream.schema(table_schema).option("pathGlobFilter", names)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
