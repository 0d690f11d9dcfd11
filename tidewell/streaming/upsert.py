"""Streaming forms of the store's reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators import kv
from tidewell.operators.store import Store


def latest(stream: DataFrame) -> DataFrame:
    """Latest version per key of a stream of (key, value, ts, seq, op): the batch reducer as streaming state."""
    return kv.latest(stream)


def window_ops(stream: DataFrame, ts: str, width: str, late: str, op: str) -> DataFrame:
    """Operations per time window and kind; windows close when the watermark passes them."""
    w = F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("_w"), op).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), op, "n")


def into_store(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Write a stream of (key, value, op[, ts]) into a store, each micro-batch once, all that is available.

    The checkpoint names the stream: a micro-batch that a restart sends again is skipped, and other writes between
    micro-batches take nothing from it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, (checkpoint, batch_id))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is available now and return its result."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
