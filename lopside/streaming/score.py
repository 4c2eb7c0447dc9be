"""Scoring an unbounded source of files with the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lopside.learners.neighbors import NeighborModel
from lopside.plans.score import score
from lopside.schema import KEY, LABEL
from lopside.sources.bundle import Bundle


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
    files_per_batch: int | None = None, names: str | None = None,
) -> DataFrame:
    """A stream of the files in a folder, with a declared schema (streams never
    infer one). ``names`` is a pattern that file names must match."""
    reader = spark.readStream.schema(schema).format(fmt)
    if names:
        reader = reader.option("pathGlobFilter", names)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def score_stream(
    stream: DataFrame, bundle: Bundle, output: str, checkpoint: str,
    key: str = KEY, label: str = LABEL, available_now: bool = True, interval: str = "1 minute",
) -> StreamingQuery:
    """Write (key, p, pred) for every arriving row; stateless.

    ``available_now`` drains what is there and stops. Neighbour models need
    joins, so they run per micro-batch, each in a folder named by batch number
    that a retry overwrites.
    """
    columns = [key, "p", "pred"]
    if isinstance(bundle.model, NeighborModel):
        def write_batch(rows: DataFrame, batch_id: int) -> None:
            scored = score(rows, bundle, key, label).select(*columns)
            scored.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

        writer = stream.writeStream.foreachBatch(write_batch)
    else:
        scored = score(stream, bundle, key, label).select(*columns)
        writer = scored.writeStream.format("parquet").option("path", output).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
