"""The same conversions under Structured Streaming: no operator here needs state across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.convert import Options, convert_df


def convert_stream(source: DataFrame, from_format: str, to_format: str, options: Options | None = None, **columns: str) -> DataFrame:
    """A streaming DataFrame of converted documents."""
    return convert_df(source, from_format, to_format, options, **columns)


def run_available(spark: SparkSession, source: str, pattern: str, out: str, checkpoint: str, from_format: str, to_format: str, options: Options | None = None, **columns: str) -> StreamingQuery:
    """Converts the Parquet files of a folder that are new since the last run, exactly once, then stops.

    ``pattern`` names files of the folder, or folders of files in it, as Spark writes a table.
    """
    at = f"{source.rstrip('/')}/{pattern}"
    schema = spark.read.parquet(at).schema
    made = convert_stream(spark.readStream.schema(schema).parquet(at), from_format, to_format, options, **columns)
    return made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
