"""Query monitoring: started / progress / terminated events as plain records."""

from __future__ import annotations

import json

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def progress_record(progress) -> dict:
    """The figures worth keeping from one progress report."""
    p = json.loads(progress.json) if hasattr(progress, "json") else dict(progress)
    dropped = sum(int(op.get("numRowsDroppedByWatermark", 0) or 0)
                  for op in p.get("stateOperators", []))
    return {
        "id": p.get("id"),
        "batchId": p.get("batchId"),
        "numInputRows": p.get("numInputRows"),
        "watermark": (p.get("eventTime") or {}).get("watermark"),
        "rowsDroppedByWatermark": dropped,
        "stateRows": sum(int(op.get("numRowsTotal", 0) or 0) for op in p.get("stateOperators", [])),
    }


class ProgressCollector(StreamingQueryListener):
    """Keeps every event of every query; optionally prints them."""

    def __init__(self, echo: bool = False) -> None:
        self.events: list[dict] = []
        self.echo = echo

    def _add(self, rec: dict) -> None:
        self.events.append(rec)
        if self.echo:
            print(rec)

    def onQueryStarted(self, event) -> None:
        self._add({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        self._add({"event": "progress", **progress_record(event.progress)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add({"event": "terminated", "id": str(event.id), "exception": event.exception})


def query_progress(query: StreamingQuery) -> list[dict]:
    """The same records read from a query's recent progress (no listener needed)."""
    return [progress_record(p) for p in query.recentProgress]
