"""Structured Streaming into samples and top-K tables.

Every micro-batch is inserted in each dependent table. Updates add, so late rows reach the slot
of their own time without a watermark. A batch is written to a folder of its own number, over
what is there, so that a batch that Spark replays counts once, also after a restart. A table that
fails does not stop the others, but fails the batch, which Spark then tries again.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import AqpSession

log = logging.getLogger(__name__)


def collect_samples(session: AqpSession, rows: DataFrame, tables: list[str], batch_id: int | None = None) -> None:
    """Insert rows in each of the tables; raises at the end if one failed."""
    failed = None
    for name in tables:
        try:
            if name.lower() in session.registry.topks:
                session.registry.insert_topk(name, rows, batch_id)
            else:
                session.registry.insert_sample(name, rows, batch_id=batch_id)
        except Exception as e:
            log.exception("batch %s did not reach %s", batch_id, name)
            failed = e
    if failed is not None:
        raise failed


def save_stream(session: AqpSession, stream: DataFrame, tables: list[str], checkpoint: str, formatter: Callable[[DataFrame], DataFrame] | None = None, once: bool = False) -> StreamingQuery:
    """Start feeding tables from a stream; formatter maps each micro-batch first."""

    def insert(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            collect_samples(session, formatter(batch) if formatter else batch, tables, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed(stream: DataFrame, time: str, duration: str, slide: str | None = None, late: str | None = None, by: list[str] = (), **aggs) -> DataFrame:
    """Counts and aggregates over tumbling or sliding windows; `late` sets a watermark."""
    rows = stream.withWatermark(time, late) if late else stream
    window = F.window(time, duration, slide) if slide else F.window(time, duration)
    return rows.groupBy(window, *by).agg(*[F.expr(e).alias(n) for n, e in (aggs or {"n": "count(*)"}).items()])


def stop_all(session: AqpSession) -> None:
    for q in session.spark.streams.active:
        q.stop()
