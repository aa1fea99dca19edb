"""Landed study pages as a stream: each micro-batch replaces the rows of the companies it brings,
in the buckets of these companies only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from larkspur.sources.landing import PAGE, flatten_studies
from larkspur.sources.warehouse import ingest


def stream_studies(spark: SparkSession, landing: str, root: str, checkpoint: str, name: str = "trials") -> StreamingQuery:
    """Read new page files and keep the stored table current; ends when all files there are have been read.

    A batch that is run again after a failure replaces the same companies with the same rows, so it leaves the same table.
    Pages with an error leave their company as it is.
    """

    def put(batch: DataFrame, _: int) -> None:
        good = batch.where(F.col("error").isNull() & F.col("company_ticker").isNotNull())
        ingest(batch.sparkSession, root, name, flatten_studies(good), good.select("company_ticker"))

    pages = spark.readStream.schema(PAGE).json(landing)
    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
