"""Detection on streams: a unit's spans depend on the unit alone, so they are found as units arrive.

The passes over whole documents need all of a document and are run on what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import recognizers


def read_units(spark: SparkSession, folder: str, schema: str = "doc_id bigint, unit_id int, text string, context array<string>, arrived timestamp", files: int = 100) -> DataFrame:
    """Units from a folder of Parquet files that grows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def detect(units: DataFrame, config: C.RunConfig | None = None, **options) -> DataFrame:
    """A stream of units with their spans."""
    return recognizers.detect(units, config, **options)


def counts(units: DataFrame, window: str = "1 minute", late: str = "10 minutes", time_col: str = "arrived") -> DataFrame:
    """Spans by type and window of arrival; windows close when their time is over by ``late``."""
    spans = units.withWatermark(time_col, late).select(time_col, F.explode("spans").alias("s"))
    return spans.groupBy(F.window(time_col, window), F.col("s.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))


def write(units: DataFrame, folder: str, checkpoint: str):
    """Starts writing a stream as Parquet, each file once; ends when all that is there is read."""
    return units.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
