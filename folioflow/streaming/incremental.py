"""Incremental conversion with Structured Streaming: text files that arrive in a folder are cleaned and judged once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from folioflow.functions import text as T
from folioflow.functions.cleanup import clean_markdown

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def cleaned(documents: DataFrame) -> DataFrame:
    """doc_id, quality and clean text; the same plan serves batches and streams."""
    quality = T.quality(F.col("text"), F.lit(""))
    return documents.select("doc_id", quality["status"].alias("quality_status"), quality["warning"].alias("warning"), clean_markdown(F.col("text")).alias("clean_markdown"))


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Convert the Parquet files that are in ``folder`` now or come later, and append to ``target``; stops when caught up."""
    stream = cleaned(spark.readStream.schema(DOCUMENTS).parquet(folder))
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target)
    return writer.trigger(availableNow=True).start()
