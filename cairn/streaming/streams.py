"""Resumable audits and run folds as streams.

The checkpoint is the cursor: a drip that is stopped, killed or out of budget goes on where it stopped, and never
audits a file twice in a sweep. State lives in the state store, so a fold survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

TAIL = 50


def audit_drip(spark: SparkSession, root: str, checkpoint: str, sink: str, ok, files_per_batch: int = 1000, once: bool = True, seconds: float | None = None):
    """Audit the files below ``root`` that this checkpoint has not seen, into ``sink``.

    ``ok(content)`` gives a column. ``files_per_batch`` throttles a micro-batch, ``seconds`` is the time between two; with
    ``once`` the query ends when all present files are done. Its batches overwrite their own folder, so a replay after
    a failure leaves no second rows. Stop (T8) by ``query.stop()``.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
    checked = source.select("path", F.col("length").alias("size"), F.coalesce(ok(F.col("content")), F.lit(False)).alias("ok"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").json(f"{sink}/{number}")

    writer = checked.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds or 60} seconds")
    return writer.start()


def drip_totals(spark: SparkSession, sink: str) -> DataFrame:
    """What a sweep has done so far."""
    rows = spark.read.schema("path string, size long, ok boolean, batch int").json(f"{sink}/*")
    return rows.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if("ok").alias("ok_files"), F.count_if(~F.col("ok")).alias("failed"))


STATE = "events long, errors long, last_seq long, status string, bytes_done long"
FOLDED = "run_id string, events long, errors long, last_seq long, status string, bytes_done long"
#: Kinds that end a run, and the status they leave.
ENDS = {"run_completed": "completed", "run_failed": "failed", "run_cancelled": "cancelled"}
PAUSES = {"run_paused": "paused", "run_resumed": "running"}


def fold_runs(events: DataFrame) -> DataFrame:
    """The state of each run after its events (run_id, seq, kind, bytes_done): counters and the status machine.

    An ended run stays ended; events that are replayed (sequence numbers already seen) change nothing. Rows of a run
    come in one after another, and the state holds five numbers, however long a run is.
    """
    import pandas as pd

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, errors, last, status, done = state.get if state.exists else (0, 0, -1, "running", 0)
        for frame in frames:
            for seq, kind, more in frame.sort_values("seq")[["seq", "kind", "bytes_done"]].itertuples(index=False):
                if seq <= last:
                    continue
                n, last = n + 1, seq
                errors += kind == "error"
                done = max(done, 0 if pd.isna(more) else int(more))
                if status not in ENDS.values():
                    status = ENDS.get(kind, PAUSES.get(kind, status))
        state.update((int(n), int(errors), int(last), status, int(done)))
        yield pd.DataFrame([(key[0], n, errors, last, status, done)], columns=["run_id", "events", "errors", "last_seq", "status", "bytes_done"])

    return events.groupBy("run_id").applyInPandasWithState(update, FOLDED, STATE, "update", "NoTimeout")


def event_sink(events: DataFrame, path: str, checkpoint: str):
    """Events as JSON lines."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """What a running audit tells: an event a micro-batch with the files and bytes so far, the rate, and the time left.

    ``emit`` gets each event as a dictionary; ``total`` is the number of files there are, if it is known.
    """

    def __init__(self, emit, total: int | None = None):
        self.emit, self.total, self.files, self.seconds = emit, total, 0, 0.0

    def onQueryStarted(self, event):
        self.emit({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event):
        p = event.progress
        self.files += p.numInputRows
        self.seconds += p.batchDuration / 1000
        rate = self.files / self.seconds if self.seconds else None
        left = (self.total - self.files) / rate if self.total is not None and rate else None
        self.emit({"event": "progress", "batch": p.batchId, "files": self.files, "total": self.total, "files_per_second": rate, "seconds_left": left})

    def onQueryIdle(self, event):
        self.emit({"event": "idle", "files": self.files})

    def onQueryTerminated(self, event):
        self.emit({"event": "failed" if event.exception else "ended", "files": self.files, "error": event.exception})
