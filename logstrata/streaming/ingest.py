"""Streams of operations into a stored table, and a stream of changed keys.

Each micro-batch becomes one run (the batch boundary stands for a frozen
buffer), numbered after those before it, and compaction is looked at after it.
The checkpoint of the query restarts it where it stopped; a batch that was
flushed before a crash is recognised by its number in the manifest and not stored
twice. Late operations are stored like others; the table refuses only what is
older than a dropped tombstone (``lateness`` says how long those are kept).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logstrata.sources.table import KVTable


def store_batch(table: KVTable, batch: DataFrame, *, number: tuple[str, int] | None = None, compact: bool = True) -> None:
    """``number``: the stream and the number of its batch; without it, every call stores its rows."""
    table.flush(batch, batch=number)
    while compact and table.compact():
        pass


def upsert_stream(ops: DataFrame, table: KVTable, checkpoint: str, *, compact: bool = True, available_now: bool = True) -> StreamingQuery:
    """Starts storing a stream of op-log rows, in any order of ``seq``. The checkpoint folder names the stream."""
    writer = ops.writeStream.foreachBatch(lambda batch, number: store_batch(table, batch, number=(checkpoint, number), compact=compact)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def unordered_stream(ops: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Operations in any order: state keeps each key's greatest seq, and only rows that move it forward come out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else -1
        row = None
        for batch in batches:
            at = batch.seq.idxmax()
            if batch.seq[at] > best:
                best, row = int(batch.seq[at]), batch.loc[[at]]
        if row is not None:
            state.update((best,))
            yield row[["key", "seq", "value", "deleted"]]

    schema = "key string, seq long, value string, deleted boolean"
    moved = ops.groupBy("key").applyInPandasWithState(step, schema, "seq long", "append", GroupStateTimeout.NoTimeout)
    return moved.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
