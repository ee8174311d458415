"""Feeding the stores from Structured Streaming, one idempotent run per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.kv import KV
from tidemark.operators.upsert import UpsertStore


def upsert_batches(store: UpsertStore, *, fan_in: int | None = 8) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: micro-batch n becomes run n, so a batch that is replayed changes nothing.

    That holds across restarts and compactions: a store opened again on its path knows
    its runs, and which of them were merged.  After every batch runs of like size are merged when
    there are ``fan_in`` of them, so their number stays logarithmic (None: never).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if store.upsert(batch, batch_id) and fan_in:
            store.compact(fan_in=fan_in)

    return write


def kv_batches(kv: KV, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that applies rows (key, vtype, value) to a store in ``order``.

    A batch is applied once: the store remembers the number of its last batch,
    also across restarts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kv.write_frame(batch, order, batch=batch_id)

    return write


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all that is available, in micro-batches, and stop."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
