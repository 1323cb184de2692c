"""The states of jobs, held between batches: queued, running, succeeded, failed, queued again, and failed
where no answer came in time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from attestra.streaming.jobs import TRANSITIONS

TIMEOUT_S = 600
STEPS = "job string, id long, at long, step string"  # ``at`` in microseconds
LOG = "job string, id long, at long, status string, attempts int, refused string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobStates(StatefulProcessor):
    """One job: its status, since when, and how often it was started. A running job has a timer for its deadline."""

    def __init__(self, timeout_s: float):
        self.timeout = int(timeout_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, since long, attempts int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        status, since, attempts = self.state.get() if self.state.exists() else (None, 0, 0)
        before = (status, since)
        for r in sorted(rows, key=lambda r: (r.at, r.id)):
            if status == "running" and r.at >= since + self.timeout:  # the answer came too late, though no batch fell between
                status, since = "failed", since + self.timeout
                yield self.line(key, None, since, status, attempts, None)
            if r.step in TRANSITIONS.get(status, ()):
                status, since, attempts = r.step, r.at, attempts + (r.step == "running")
                yield self.line(key, r.id, r.at, status, attempts, None)
            else:
                yield self.line(key, r.id, r.at, status, attempts, f"{status or 'new'} to {r.step}")
        if status is not None:
            self.state.update((status, since, attempts))
        if before[0] == "running" and before != (status, since):
            self.handle.deleteTimer(self.deadline(before[1]))
        if status == "running" and before != (status, since):
            self.handle.registerTimer(self.deadline(since))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        status, since, attempts = self.state.get() if self.state.exists() else (None, 0, 0)
        if status == "running" and self.deadline(since) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update(("failed", since + self.timeout, attempts))
            yield self.line(key, None, since + self.timeout, "failed", attempts, None)

    def deadline(self, since: int) -> int:
        return -(-(since + self.timeout) // 1_000)

    def line(self, key: Any, number: int | None, at: int, status: str | None, attempts: int, refused: str | None) -> Row:
        return Row(job=key[0], id=number, at=at, status=status, attempts=attempts, refused=refused)

    def close(self) -> None:
        pass


def job_log(steps: DataFrame, timeout_s: float = TIMEOUT_S, late: str = "0 seconds") -> DataFrame:
    """A line for each step of a stream of ``job, id, at, step``, taken or refused, and for each timeout: ``LOG``.

    Steps of a batch are taken in order of ``at`` and ``id``. A step that may not follow the job's state is refused
    with its reason and changes nothing. A job that runs for ``timeout_s`` without an answer fails then, whether a
    later step of its own or the watermark shows it. Rows with a null job or step are left out.
    """
    timed = steps.where("job IS NOT NULL AND step IS NOT NULL AND at IS NOT NULL").withColumn("time", F.timestamp_micros("at")).withWatermark("time", late)
    return timed.groupBy("job").transformWithState(JobStates(timeout_s), outputStructType=LOG, outputMode="Append", timeMode="EventTime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, while a query starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def follow_jobs(steps: DataFrame, out: str, checkpoint: str, timeout_s: float = TIMEOUT_S, late: str = "0 seconds") -> StreamingQuery:
    """Takes all steps that are there and adds their lines to ``out``; a further run goes on from the checkpoint's states."""
    with state_store(steps.sparkSession):
        return job_log(steps, timeout_s, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def job_states(log: DataFrame) -> DataFrame:
    """``job, status, since, attempts, refused, timeouts`` of a log: the newest line that was taken, and counts."""
    taken = F.col("refused").isNull()
    found = log.groupBy("job").agg(F.max_by(F.struct("status", "at", "attempts"), F.when(taken, F.struct("at", F.col("id").isNull().alias("none"), "id"))).alias("x"), F.count_if(~taken).alias("refused"), F.count_if(taken & F.col("id").isNull()).alias("timeouts"))
    return found.select("job", "x.status", F.col("x.at").alias("since"), F.coalesce("x.attempts", F.lit(0)).alias("attempts"), "refused", "timeouts")
