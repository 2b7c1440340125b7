"""Progress of long work and jobs in the background, on the driver."""

from __future__ import annotations

import itertools
import threading
import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from verbena.operators.catalogues import transfer_rates


class Progress:
    """What a run is at: a dictionary of its state, and listeners that hear of changes, but no more often than every `interval` seconds."""

    def __init__(self, listener: Callable[[dict[str, Any]], None] | None = None, interval: float = 0.25, clock: Callable[[], float] = time.monotonic):
        self.listener, self.interval, self.clock = listener, interval, clock
        self.state: dict[str, Any] = {}
        self.transfers: dict[str, dict[str, Any]] = {}
        self._told: float | None = None
        self._lock = threading.Lock()

    def _changed(self, at_once: bool = False) -> None:
        now = self.clock()
        if self.listener and (at_once or self._told is None or now - self._told >= self.interval):
            self._told = now
            self.listener(self.snapshot())

    def snapshot(self) -> dict[str, Any]:
        return {**self.state, "transfers": {k: dict(v) for k, v in self.transfers.items()}}

    def step(self, **state: Any) -> None:
        """Set parts of the state; a new stage is told at once."""
        with self._lock:
            new_stage = "stage" in state and state["stage"] != self.state.get("stage")
            self.state.update(state)
            self._changed(new_stage)

    def start(self, key: str, name: str, size: int | None) -> None:
        with self._lock:
            self.transfers[key] = {"name": name, "size": size, "done": 0, "status": "running"}
            self._changed()

    def moved(self, key: str, done: int) -> None:
        with self._lock:
            self.transfers[key]["done"] = done
            self._changed()

    def done(self, key: str, ok: bool = True, message: str = "") -> None:
        with self._lock:
            self.transfers[key].update(status="done" if ok else "failed", message=message)
            self._changed(True)


class StreamProgress(StreamingQueryListener):
    """Progress of streaming queries, as Spark tells it: each query is a transfer, its rows so far what has moved, and each micro-batch a point in time.

    Add it to a session with spark.streams.addListener(). points is bounded: of the oldest half every other one goes when it is full.
    """

    MOST_POINTS = 100_000

    def __init__(self, progress: Progress | None = None):
        super().__init__()
        self.progress = progress or Progress()
        self.points: list[tuple[str, int, int]] = []
        self._rows: dict[str, int] = {}

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        key = str(event.runId)
        self._rows[key] = 0
        self.progress.start(key, event.name or str(event.id), None)

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        p = event.progress
        key = str(p.runId)
        self._rows[key] = self._rows.get(key, 0) + max(0, int(p.numInputRows))
        at = int(datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp() + p.batchDuration / 1000)
        if len(self.points) >= self.MOST_POINTS:
            half = len(self.points) // 2
            self.points = self.points[:half:2] + self.points[half:]
        self.points.append((key, at, self._rows[key]))
        self.progress.moved(key, self._rows[key])

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        self.progress.done(str(event.runId), event.exception is None, event.exception or "")

    def rates(self, spark: SparkSession, seconds: int = 5) -> DataFrame:
        """transfer (the run), at, bytes (rows so far), rate: see catalogues.transfer_rates(); of one second the last point."""
        last = {(k, at): n for k, at, n in self.points}
        return transfer_rates(spark.createDataFrame([(k, at, n) for (k, at), n in last.items()], "transfer string, at bigint, bytes bigint"), seconds)


@dataclass
class Job:
    number: int
    name: str
    status: str = "running"
    result: Any = None
    error: str | None = None
    messages: list[str] = field(default_factory=list)
    progress: Progress = field(default_factory=Progress)
    _stopped: threading.Event = field(default_factory=threading.Event)

    def say(self, message: str) -> None:
        self.messages.append(message)

    def cancelled(self) -> bool:
        return self._stopped.is_set()


class Jobs:
    """Work in threads of the driver, asked for by number. Spark plans the jobs of several threads side by side."""

    def __init__(self) -> None:
        self._numbers = itertools.count(1)
        self._jobs: dict[int, Job] = {}
        self._threads: dict[int, threading.Thread] = {}

    def start(self, name: str, work: Callable[[Job], Any]) -> int:
        """Run work(job) in a thread of its own; the number to poll it by."""
        job = Job(next(self._numbers), name)

        def run() -> None:
            try:
                job.result = work(job)
                job.status = "cancelled" if job.cancelled() else "finished"
            except Exception as e:
                job.error, job.status = f"{type(e).__name__}: {e}", "failed"
                job.messages.append(traceback.format_exc(limit=3))

        self._jobs[job.number] = job
        self._threads[job.number] = threading.Thread(target=run, name=f"job-{job.number}", daemon=True)
        self._threads[job.number].start()
        return job.number

    def poll(self, number: int, since: int = 0) -> dict[str, Any]:
        """A job's state, and its messages from the given one on."""
        job = self._jobs[number]
        return {"number": number, "name": job.name, "status": job.status, "error": job.error, "messages": job.messages[since:], "progress": job.progress.snapshot()}

    def cancel(self, number: int) -> None:
        self._jobs[number]._stopped.set()

    def wait(self, number: int, seconds: float | None = None) -> Job:
        self._threads[number].join(seconds)
        return self._jobs[number]

    def list(self) -> list[dict[str, Any]]:
        return [{"number": j.number, "name": j.name, "status": j.status} for j in self._jobs.values()]
