"""Structured Streaming: idempotent loads, state of staged records, and event-time windows (group R; the windows are an extension).

Streams read files as they arrive; ``available`` runs a stream over what is there and ends. Loads go through ``foreach_batch`` functions
that are idempotent: a batch that is replayed after a failure adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import idempotent_nodes
from ..session import exists, new_folder

if TYPE_CHECKING:
    import pandas as pd


def file_stream(spark: SparkSession, sf: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """A table's files as a stream, in its own schema."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/{name}.parquet*")


def available(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str) -> None:
    """Runs a stream over what has arrived, with its progress kept in the shared folder."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


def incremental_load(spark: SparkSession, stream: DataFrame, key: str, order: str, folder: str | None = None) -> DataFrame:
    """Rows with keys that are not stored yet, the first of each batch, appended once. A batch that is replayed after a failure
    is held against the other batches only and takes the place of what it wrote before; rows without a key are left out."""
    at = folder or new_folder(spark, "load")
    schema = stream.schema
    stored_schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])

    def add(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        if exists(own, f"{at}/table"):
            stored = own.read.schema(stored_schema).parquet(f"{at}/table").where(F.col("batch") != batch_id).drop("batch")
        else:
            stored = own.createDataFrame([], schema)
        idempotent_nodes(batch, stored, key, [order]).write.mode("overwrite").parquet(f"{at}/table/batch={batch_id}")

    available(stream, add, at)
    return spark.read.schema(schema).parquet(f"{at}/table")


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows per event type, with a watermark; works on streams and on tables alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# The allowed next states of a staged record.
NEXT = {"": ("staged",), "staged": ("extracted", "failed"), "failed": ("staged",), "extracted": ()}


def transitions(records: DataFrame) -> DataFrame:
    """Ticker, status, n_refused after each micro-batch: records (ticker, status, at) move only along allowed transitions; others are
    refused and counted. The state of a ticker is kept between batches."""

    def move(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd  # only here: it takes much of a driver's memory

        status, refused = state.get if state.exists else ("", 0)
        for at, to in sorted((r.at, r.status) for f in frames for r in f.itertuples()):
            if to in NEXT.get(status, ()):
                status = to
            else:
                refused += 1
        state.update((status, refused))
        yield pd.DataFrame({"ticker": [key[0]], "status": [status], "n_refused": [refused]})

    out = "ticker string, status string, n_refused bigint"
    return records.groupBy("ticker").applyInPandasWithState(move, out, "status string, n_refused bigint", "update", GroupStateTimeout.NoTimeout)
