"""Blocks that arrive as a stream, decoded as they come: no state is carried from one to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def block_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files at the path (a pattern), with the schema of a table like them."""
    return spark.readStream.schema(like.schema).parquet(path)


def decode_available(blocks: DataFrame, decoder: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """Decodes all that a stream holds now into Parquet files below out, each block once, and reads them back."""
    query = decoder(blocks).writeStream.format("parquet").option("path", f"{out}/texels").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return blocks.sparkSession.read.parquet(f"{out}/texels")
