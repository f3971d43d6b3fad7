"""Tasks as keyed state of a stream: what an event may change, deadlines, expiry and recovery, in event time.

Each task is one key. Its state lives in the state store and comes back from the checkpoint after a restart; timers follow the
watermark, so deadlines pass when the stream's own time does, not the machine's.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quaylight import vocabulary as V

EVENT = "task_id string, ts timestamp, status string, progress int"
CHANGE = "task_id string, ts timestamp, status string, progress int, note string"
FINAL = ("completed", "failed")
#: Hours after which a task that nothing is heard of has failed.
DEADLINE_HOURS = 6
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _millis(ts: datetime) -> int:
    return (ts.astimezone(timezone.utc) - _EPOCH) // timedelta(milliseconds=1)


class TaskStates(StatefulProcessor):
    """Events to changes: note is '' for those made, refused for those that the state forbids, restarted, stale and expired for what time and restarts do."""

    def __init__(self, deadline_hours: int = DEADLINE_HOURS, ttl_hours: int = V.TASK_TTL_HOURS):
        self.deadline, self.ttl = deadline_hours * 3_600_000, ttl_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "status string, progress int")

    def _await(self, at: int, status: str) -> None:
        """One timer a task: expiry after its end, else its deadline."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at + (self.ttl if status in FINAL else self.deadline))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, progress = self.task.get() if self.task.exists() else (None, 0)
        heard, moved = None, False
        for e in sorted(rows, key=lambda e: (e.ts, V.TASK_ORDER.index(e.status) if e.status in V.TASK_ORDER else len(V.TASK_ORDER))):
            note = ""
            if e.status == "restarted":
                if status in (None, *FINAL):
                    continue
                status, note = "failed", "restarted"
            elif (status is None and e.status == "pending") or (status, e.status) in V.TRANSITIONS:
                status, progress = e.status, 100 if e.status == "completed" else e.progress or 0
            elif status == e.status == "running" and (e.progress or 0) >= progress:
                progress = e.progress or 0
            else:
                note = "refused"
            if note != "refused":
                heard, moved = e.ts, True
            yield Row(task_id=key[0], ts=e.ts, status=status, progress=progress, note=note)
        if moved:
            self.task.update((status, progress))
            self._await(_millis(heard), status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        ts = (_EPOCH + timedelta(milliseconds=at)).replace(tzinfo=None)
        if not self.task.exists():
            return
        status, progress = self.task.get()
        if status in FINAL:
            self.task.clear()
            yield Row(task_id=key[0], ts=ts, status=status, progress=progress, note="expired")
        else:
            self.task.update(("failed", progress))
            self.handle.registerTimer(at + self.ttl)
            yield Row(task_id=key[0], ts=ts, status="failed", progress=progress, note="stale")

    def close(self) -> None:
        pass


def changes(events: DataFrame, late: str = "0 seconds", processor: TaskStates | None = None) -> DataFrame:
    """The stream of changes of a stream of events (EVENT). late: how far events may lag behind the latest one seen.

    Needs spark.sql.streaming.stateStore.providerClass to name a RocksDB store.
    """
    return events.withWatermark("ts", late).groupBy("task_id").transformWithState(processor or TaskStates(), CHANGE, "Append", "EventTime")
