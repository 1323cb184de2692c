"""The work queue as streams: resumable evaluation, job states, progress (T1-T5), windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from attestra.sources.tables import append_results


def landing(spark: SparkSession, folder: str, schema: str | None = None, files_per_trigger: int = 2, fmt: str = "parquet") -> DataFrame:
    """Work that arrives in a folder; a trigger takes a bounded number of files. Without a schema, raw files."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if schema is None:
        return reader.format("binaryFile").option("pathGlobFilter", "*").load(folder)
    return reader.schema(schema).format(fmt).load(folder)


def resume(work: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """T4: processes what is new since the last run and ends. The checkpoint gives each input once; results are added by
    key, so that a batch repeated after a failure adds nothing twice."""

    def sink(batch: DataFrame, _: int) -> None:
        append_results(process(batch.dropDuplicates([key])), out, key)

    return work.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes", key: str = "event_type", value: str = "value") -> DataFrame:
    """An extension: counts and sums of events in tumbling windows, late ones accepted up to a watermark. Timestamps
    without zone are taken as the session's."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(at, late)
    sums = timed.groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("window_start"), key, "n", "total")


#: Which states follow which.
TRANSITIONS = {None: ("queued",), "queued": ("running",), "running": ("succeeded", "failed"), "failed": ("queued",)}


def allowed_step(before: Column, after: Column) -> Column:
    """Whether a job may go from one state to another."""
    ok = before.isNull() & (after == "queued")
    for state, following in TRANSITIONS.items():
        if state:
            ok = ok | ((before == state) & after.isin(*following))
    return F.coalesce(ok, F.lit(False))


class Progress(StreamingQueryListener):
    """T5: calls ``report(rows so far, rows of this batch, milliseconds)`` after each batch; with the number of rows in
    ``total`` known, also with the milliseconds left at the pace so far (null before the first row)."""

    def __init__(self, report: Callable[..., None], total: int | None = None):
        self.report, self.total = report, total
        self.rows, self.ms = 0, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802, ANN001
        self.rows, self.ms = 0, 0

    def onQueryProgress(self, event) -> None:  # noqa: N802, ANN001
        n, ms = event.progress.numInputRows, event.progress.batchDuration
        self.rows, self.ms = self.rows + n, self.ms + ms
        if self.total is None:
            self.report(self.rows, n, ms)
        else:
            self.report(self.rows, n, ms, self.ms * (self.total - self.rows) / self.rows if self.rows else None)

    def onQueryIdle(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802, ANN001
        pass
