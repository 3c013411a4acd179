"""Structured Streaming on the lake, beyond what batch statements give: a sink, a polled change feed, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..lake import Lake


def to_lake(lake: Lake, stream: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream to a table; each batch is one commit that names the query and batch, and one that is already there is skipped."""
    name = f"stream:{checkpoint}"

    def append(rows: DataFrame, batch: int) -> None:
        message = f"{name}:{batch}"
        if lake.catalog.one("SELECT 1 FROM snapshot_changes WHERE commit_message = ?", message):
            return
        lake.set_commit_message(message)
        lake.insert(table, rows)
        lake.set_commit_message(None)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class FeedReader:
    """Polls a table's change feed: each call returns the changes of the snapshots since the last one."""

    def __init__(self, lake: Lake, table: str, after: int | None = None):
        self.lake, self.table, self.after = lake, table, lake.last_committed_snapshot() if after is None else after

    def poll(self) -> DataFrame | None:
        last = self.lake.last_committed_snapshot()
        if last <= self.after:
            return None
        first, self.after = self.after + 1, last
        return self.lake.table_changes(self.table, first, last)


def _marked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, which needs a timestamp of the session's zone; a batch as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], *aggregates, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates by time window and keys; the same expression for a batch and for a stream with a watermark."""
    rows = _marked(events, time, late)
    return rows.groupBy(F.window(time, width, slide).alias("window"), *keys).agg(*aggregates)


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], *aggregates, late: str = "10 minutes") -> DataFrame:
    """Aggregates by session: events of the keys with less than ``gap`` between them."""
    rows = _marked(events, time, late)
    return rows.groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*aggregates)
