"""Continuous indexing: every micro-batch of a stream becomes a segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.fields import FieldSpec
from ..operators.index import Store


def index_stream(stream: DataFrame, store: Store, id_col: str, specs: Sequence[FieldSpec], checkpoint: str, compact_every: int = 0, **trigger: object) -> StreamingQuery:
    """Appends a segment per non-empty micro-batch; merges all into one after every ``compact_every`` of them.

    A batch that is replayed after a failure is not indexed twice: its number
    enters the catalog in the same rename as its segment.
    """

    def add(batch: DataFrame, number: int) -> None:
        if batch.isEmpty() or store.append(batch, id_col, specs, batch=number) is None:
            return
        if compact_every and len(store.catalog()["segments"]) >= compact_every:
            store.compact()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
