"""A stream of operations into a store: every micro-batch is one write and one sync.

The batch number is kept in the commit, so a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store


def apply_batch(store: Store, ops: DataFrame, batch_id: int) -> int:
    """Applies a micro-batch of operations (ord, kind, k, v, lo, hi) once; returns the durable sequence."""
    if store._manifest.has_batch(batch_id):
        return store.durable_seq()
    store.write_frame(ops)
    return store.sync(batch_id)


def start(store: Store, stream: DataFrame, checkpoint: str):
    """Starts the stream; the caller stops it."""
    return stream.writeStream.foreachBatch(lambda df, i: apply_batch(store, df, i) and None).option("checkpointLocation", checkpoint).start()


def latest_values(events: DataFrame, key: str, value: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """The newest value per key of a stream, as an aggregation over its state."""
    newest = events.withWatermark(time, delay)
    return newest.groupBy(key).agg(F.max_by(value, time).alias(value))
