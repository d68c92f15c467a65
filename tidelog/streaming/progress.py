"""Progress and health of streaming queries, kept where a monitor can read them."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Progress(StreamingQueryListener):
    """The last progress of each query by its name or id, and the error that ended it."""

    def __init__(self):
        self.last: dict[str, dict] = {}
        self.rows: dict[str, int] = {}
        self.errors: dict[str, str | None] = {}

    def onQueryStarted(self, event):
        self.last.setdefault(event.name or str(event.id), {})

    def onQueryProgress(self, event):
        p = event.progress
        name = p.name or str(p.id)
        self.last[name] = {"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "milliseconds": dict(p.durationMs)}
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.errors[str(event.id)] = event.exception


def health(query: StreamingQuery, frontier: int, end: int) -> dict:
    """Whether a query runs, why not, and how far it is behind the end of the log."""
    error = query.exception()
    return {"running": query.isActive, "error": None if error is None else str(error), "next_offset": frontier, "lag": max(0, end - frontier)}
