"""Signals of streaming queries, as counters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Signals(StreamingQueryListener):
    """Counts starts, rows and ends, and calls receivers by signal name: 'opened', 'progress', 'idle', 'closed'."""

    def __init__(self, receivers: dict[str, list[Callable]] | None = None):
        self.receivers, self.stats = receivers or {}, Counter()

    def _send(self, signal: str, event) -> None:
        self.stats[f"signal/{signal}"] += 1
        for receiver in self.receivers.get(signal, ()):
            try:
                receiver(event)
            except Exception as e:  # a receiver's failure must not stop the stream
                self.stats[f"signal_errors/{type(e).__name__}"] += 1

    def onQueryStarted(self, event) -> None:
        self._send("opened", event)

    def onQueryProgress(self, event) -> None:
        self.stats["rows"] += event.progress.numInputRows
        self._send("progress" if event.progress.numInputRows else "idle", event)

    def onQueryIdle(self, event) -> None:
        self._send("idle", event)

    def onQueryTerminated(self, event) -> None:
        self.stats["finish_reason/" + ("error" if event.exception else "finished")] += 1
        self._send("closed", event)
