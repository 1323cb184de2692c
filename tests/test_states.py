"""Job states as a stream against a plain walk through the steps."""

from __future__ import annotations

import random

import pytest

from attestra.streaming import states
from attestra.streaming.jobs import TRANSITIONS


def plain(steps, timeout_s, late_s=0):
    limit = int(timeout_s * 1e6)
    jobs = {}
    for job, number, at, step in sorted(steps, key=lambda s: (s[2], s[1])):
        x = jobs.setdefault(job, [None, None, 0, 0, 0])
        if x[0] == "running" and at >= x[1] + limit:
            x[0], x[1], x[4] = "failed", x[1] + limit, x[4] + 1
        if step in TRANSITIONS.get(x[0], ()):
            x[0], x[1], x[2] = step, at, x[2] + (step == "running")
        else:
            x[3] += 1
    end = max(at for _, _, at, _ in steps) - late_s * 1e6
    for x in jobs.values():
        if x[0] == "running" and x[1] + limit <= end:
            x[0], x[1], x[4] = "failed", x[1] + limit, x[4] + 1
    return sorted((job, *x) for job, x in jobs.items())


@pytest.mark.parametrize("runs", [[3], [1, 2]])
def test_job_states(spark, tmp_path, runs):
    """In one run, and stopped and started anew from the checkpoint: the same states."""
    r = random.Random(5)
    steps = [(f"j{r.randrange(25)}", i, i * 40_000_000 + r.randrange(30_000_000), r.choice(["queued", "running", "running", "succeeded", "failed"])) for i in range(600)]
    steps += [("lone", 1000, 100 * 40_000_000, "queued"), ("lone", 1001, 101 * 40_000_000, "running")]
    steps += [("end", 1002, 590 * 40_000_000, "queued"), ("end", 1003, 599 * 40_000_000, "running"), ("bad", 1004, 599 * 40_000_000, "succeeded")]
    parts = [[s for s in steps if k * 200 <= s[2] // 40_000_000 < k * 200 + 200] for k in range(3)]
    work, out, mark = (str(tmp_path / n) for n in ("work", "out", "mark"))
    given = 0
    for n in runs:
        for part in parts[given : given + n]:
            spark.createDataFrame(part, states.STEPS).coalesce(1).write.mode("append").parquet(work)
        given += n
        stream = spark.readStream.schema(states.STEPS).option("maxFilesPerTrigger", 1).parquet(work)
        states.follow_jobs(stream, out, mark, 600).awaitTermination()
    got = states.job_states(spark.read.schema(states.LOG).parquet(out)).select("job", "status", "since", "attempts", "refused", "timeouts").collect()
    want = plain(steps, 600)
    assert sorted((tuple(x) for x in got)) == want or [tuple(x) for x in sorted(got, key=lambda x: x.job)] == want
    assert any(x[5] for x in want) and dict((x[0], x[1]) for x in want)["lone"] == "failed"


def test_corrections_are_refused_with_a_reason(spark):
    from attestra.operators import records

    jobs = spark.createDataFrame([("a", "succeeded"), ("b", "running"), ("c", None), ("d", "failed"), (None, "failed")], "job string, status string")
    rows = [(1, "a", '{"x": 1}'), (2, "a", "[1]"), (3, "a", "no"), (4, "a", None), (5, "b", "{}"), (6, "c", "{}"), (7, "z", "{}"), (8, None, "{}"), (9, "d", "{}"), (10, "z", "no")]
    found = records.checked_corrections(spark.createDataFrame(rows, "id int, job string, body string"), jobs, "job", "body")
    assert {r.id: r.refused for r in found.collect()} == {1: None, 2: "bad body", 3: "bad body", 4: "bad body", 5: "job has not ended", 6: "job has not ended", 7: "unknown job", 8: "unknown job", 9: None, 10: "unknown job"}


def test_progress_tells_what_is_left():
    from types import SimpleNamespace

    from attestra.streaming.jobs import Progress

    seen = []
    progress = Progress(lambda *x: seen.append(x), total=100)
    for n, ms in ((0, 5), (20, 35), (30, 60)):
        progress.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(numInputRows=n, batchDuration=ms)))
    assert seen == [(0, 0, 5, None), (20, 20, 35, 160.0), (50, 30, 60, 100.0)]
