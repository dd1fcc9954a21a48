"""Append-only logs that a replayed batch adds nothing to, and a count of the rows that came too late."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener


def once(path: str) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: every batch has a folder of its own under `path`. A batch that was committed is left as it is, one
    that broke off is written anew, so batches may be replayed after a restart. Read the log back as one Parquet table."""

    def append(batch: DataFrame, batch_id: int) -> None:
        folder = f"{path.rstrip('/')}/batch={batch_id}"
        jvm = batch.sparkSession._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not done.getFileSystem(batch.sparkSession._jsparkSession.sessionState().newHadoopConf()).exists(done):
            batch.write.mode("overwrite").parquet(folder)

    return append


class LateRows(StreamingQueryListener):
    """Counts rows that state operators dropped since they lay behind the watermark, by the id of the query."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.ended.setdefault(str(event.id), threading.Event()).clear()

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        of, progress = str(event.progress.id), event.progress
        self.dropped[of] = self.dropped.get(of, 0) + sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.ended.setdefault(str(event.id), threading.Event()).set()

    def total(self, query_id: str, wait: float = 60) -> int:
        """Of a query that has ended; all its progress comes before its end."""
        if not self.ended.setdefault(query_id, threading.Event()).wait(wait):
            raise TimeoutError(f"no word of the end of {query_id}")
        return self.dropped.get(query_id, 0)
