"""Extension: documents that arrive as a stream are chunked and matched with the memory as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstream.operators import chunks as chunk_ops


def arriving(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def first_deliveries(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """The first delivery of each key; state is kept as long as rows may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, time: str, by: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows a window and value of ``by``."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def chunk_stream(stream: DataFrame, path: str, body: str, out: str, checkpoint: str) -> StreamingQuery:
    """Chunks of arriving documents, each trigger's written under its number, so that a trigger run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_ops.extract(batch, path, body).select("path", "ordinal", "chunk_id", "source_text", "content_hash", "block_kind").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
