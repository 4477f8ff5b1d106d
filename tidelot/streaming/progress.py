"""Progress of streams as a table: what a scraper would poll."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "query string, run string, batch bigint, at string, rows bigint, rows_per_s double, batch_ms bigint"


class ProgressLog(StreamingQueryListener):
    """Keeps the last `most` progress reports of all streams of a session; add it by `spark.streams.addListener`."""

    def __init__(self, most: int = 10_000):
        self._rows: deque[tuple] = deque(maxlen=most)
        self._lock = threading.Lock()
        self.started, self.ended = 0, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.started += 1

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self._lock:
            self._rows.append((p.name, str(p.runId), p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond or 0.0), int(p.durationMs.get("triggerExecution", 0))))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended += 1

    def frame(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            return spark.createDataFrame(list(self._rows), SCHEMA)
