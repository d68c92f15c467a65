"""A backfill from its first chunk to the last, and the log after it."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame

from tidelog.plans.backfill import Backfills, Lease


class Transient(RuntimeError):
    """An error that a retry may cure."""


def retry(step: Callable, attempts: int = 5, first: float = 0.1, most: float = 5.0, factor: float = 2.0, transient: Callable[[Exception], bool] = lambda e: isinstance(e, (Transient, ConnectionError, TimeoutError)), sleep: Callable[[float], None] = time.sleep):
    """The step's result; a transient error is tried again after a wait that doubles. An interruption is never retried."""
    wait = first
    for attempt in range(1, max(1, attempts) + 1):
        try:
            return step()
        except Exception as e:
            if attempt >= attempts or not transient(e):
                raise
            sleep(wait)
            wait = min(most, wait * factor)


class Permits:
    """At most `scans` at once, and none while the log's lag is over `max_lag` (0: any lag)."""

    def __init__(self, scans: int, max_lag: int = 0, lag: Callable[[], int] = lambda: 0, poll: float = 0.05):
        if scans < 1 or max_lag < 0:
            raise ValueError("permits must be positive, and the lag not negative")
        self.free, self.max_lag, self.lag, self.poll = threading.BoundedSemaphore(scans), max_lag, lag, poll

    @contextmanager
    def scan(self, give_up: float | None = None):
        started = time.monotonic()
        while self.max_lag and self.lag() > self.max_lag:
            if give_up is not None and time.monotonic() - started > give_up:
                raise TimeoutError(f"the lag is {self.lag()}, over {self.max_lag}")
            time.sleep(self.poll)
        with self.free:
            yield


class Phases:
    """Seconds and runs of named phases."""

    def __init__(self):
        self.seconds, self.runs = {}, {}

    @contextmanager
    def phase(self, name: str):
        started = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - started
            self.runs[name] = self.runs.get(name, 0) + 1


class Failpoints:
    """Named points at which a test lets a run fail, or wait until it is told to go on."""

    NAMES = ("classified", "folded", "written", "committed", "before_commit", "promotion_intent")

    def __init__(self):
        self.failures: dict[str, Exception] = {}
        self.gates: dict[str, threading.Event] = {}

    def fail(self, name: str, error: Exception) -> None:
        self.failures[self._known(name)] = error

    def hold(self, name: str) -> threading.Event:
        return self.gates.setdefault(self._known(name), threading.Event())

    def _known(self, name: str) -> str:
        if name not in self.NAMES:
            raise ValueError(f"no failpoint {name!r}")
        return name

    def __call__(self, name: str) -> None:
        if name in self.gates:
            self.gates[name].wait()
        if name in self.failures:
            raise self.failures.pop(name)


def run_chunk(jobs: Backfills, lease: Lease, scan: Callable[[int, int], DataFrame], mark: Callable[[str, Lease], str], follow: Callable[[], None], folder: str, phases: Phases | None = None) -> int:
    """LOW, scan, stage, HIGH, apply the log up to HIGH, complete: the rows that the chunk put in the target.

    `mark` puts a marker in the log and gives its id; `follow` applies what the log holds by now.
    """
    phases = phases or Phases()
    with phases.phase("low"):
        jobs.begin_scan(lease, mark("low", lease))
    with phases.phase("stage"):
        jobs.stage(lease, scan(lease.chunk_min, lease.chunk_max), folder)
    with phases.phase("high"):
        jobs.seal_scan(lease, mark("high", lease))
    with phases.phase("follow"):
        follow()
    with phases.phase("complete"):
        return jobs.finalise(lease)


def run_backfill(jobs: Backfills, name: str, owner: str, scan, mark, follow, folder: str, lease_seconds: float = 600.0, permits: Permits | None = None, phases: Phases | None = None, together: int = 1) -> int:
    """All chunks of a job, then it is ready to verify; the rows written.

    With `together` > 1 so many chunks are opened, scanned and closed before the log is followed once for all of them: their
    windows overlap, and each is judged by its own markers. Spark's tasks do the scanning side by side.
    """
    permits, written = permits or Permits(max(1, together)), 0
    while True:
        held = []
        while len(held) < together and (lease := jobs.lease(name, f"{owner}-{len(held)}", lease_seconds)):
            held.append(lease)
        if not held:
            return written
        for lease in held:
            jobs.begin_scan(lease, mark("low", lease))
        for lease in held:
            with permits.scan():
                jobs.stage(lease, scan(lease.chunk_min, lease.chunk_max), folder)
        for lease in held:
            jobs.seal_scan(lease, mark("high", lease))
        follow()
        for lease in held:
            written += jobs.finalise(lease)
        if phases is not None:
            phases.runs["chunks"] = phases.runs.get("chunks", 0) + len(held)
        if jobs.job(name)["state"] != "running":
            return written


