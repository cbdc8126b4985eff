"""Mapping of queries as they arrive, against a fixed index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandweave.plans.mapping import Counts, Index, map_queries


def map_stream(queries: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, report: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Start a stream that maps each micro-batch of ``queries`` (seq_id, name, seq) and hands it to ``sink``.

    Mapping is by query, so batches need no state; ``sink`` gets the batch number and can be made idempotent by it.
    ``report`` gets each batch's counts, which are taken as it is mapped; the sink is to read the mappings to their end.
    One-to-one filtering and seed frequencies need all queries at once and are not for streams.
    """
    if index.params.filter_mode == "one-to-one":
        raise ValueError("one-to-one needs all queries; map in batch")

    def one(batch: DataFrame, n: int) -> None:
        counts = Counts() if report else None
        sink(map_queries(batch, index, counts), n)
        if report:
            report(n, counts.get())

    writer = queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
