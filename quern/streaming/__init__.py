"""Bounded batch streams: the filter and the running sum over files as they arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.types import DEFAULT_BOUND


def batch_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Each parquet file of ``path`` is a batch, pulled in turn."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def streaming_filter(stream: DataFrame, column: str = "v", bound: int = DEFAULT_BOUND) -> DataFrame:
    return stream.filter(F.col(column) < F.lit(bound))


def streaming_sum(stream: DataFrame, column: str = "v") -> DataFrame:
    return stream.agg(F.sum(column).alias("sum"))
