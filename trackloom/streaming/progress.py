"""Metrics of running streams: what a query's progress says, as samples (ts, metric, labels, value)."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: Names of the samples and where a progress report has their values.
SAMPLES = {
    "fleet_ingest_received_rows": lambda p: p.numInputRows,
    "fleet_ingest_rows_per_second": lambda p: p.processedRowsPerSecond,
    "fleet_ingest_batch_seconds": lambda p: (p.durationMs or {}).get("triggerExecution", 0) / 1000,
    "fleet_ingest_state_devices": lambda p: sum(s.numRowsTotal for s in p.stateOperators),
}
SCHEMA = "ts string, metric string, labels map<string,string>, value double"


class ProgressSamples(StreamingQueryListener):
    """Keeps the newest ``keep`` samples of all queries; ``samples`` gives them as a DataFrame."""

    def __init__(self, keep: int = 10_000):
        self.keep, self.rows, self.lock = keep, [], Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        new = [(p.timestamp, name, {"query": p.name or str(p.id)}, float(value(p))) for name, value in SAMPLES.items()]
        with self.lock:
            self.rows = (self.rows + new)[-self.keep :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def samples(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(list(self.rows), SCHEMA)
