"""Pending writes held as state until there are enough of them, or they have waited long enough."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.merge import FLUSH

#: How many different writes are flushed together, and after how many milliseconds what is there is flushed.
MOST, WAIT = 1024, 50
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "project_id string, part int, flush long, reason string, place int, op string, entity string, payload string, seq long, delta long"


class Pending(StatefulProcessor):
    """The last write of each entity, deltas of weights summed, enrichments all kept; by project and part of it."""

    def __init__(self, most: int = MOST, wait: int = WAIT):
        self.most, self.wait = most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.writes = handle.getMapState("writes", "op string, entity string, nth long", "payload string, seq long, delta long")
        self.counts = handle.getValueState("counts", "pending long, flushes long")

    def _counts(self) -> tuple[int, int]:
        return tuple(self.counts.get()) if self.counts.exists() else (0, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, flushes = self._counts()
        for r in rows:
            # every enrichment is a write of its own
            at = (r.op, r.entity, r.seq if r.op == "enrichment" else 0)
            delta = (r.delta or 0) if r.op == "weight" else 0
            if self.writes.containsKey(at):
                old = self.writes.getValue(at)
                last = (old[0], old[1]) if old[1] > r.seq else (r.payload, r.seq)
                self.writes.updateValue(at, (*last, old[2] + delta))
            else:
                self.writes.updateValue(at, (r.payload, r.seq, delta))
                n += 1
            if n >= self.most:
                yield from self._flush(key, flushes, "full")
                n, flushes = 0, flushes + 1
        self.counts.update((n, flushes))
        timers = list(self.handle.listTimers())
        if n and not timers:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        elif not n:
            for t in timers:
                self.handle.deleteTimer(t)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, flushes = self._counts()
        if n:
            yield from self._flush(key, flushes, "time")
            self.counts.update((0, flushes + 1))

    def _flush(self, key, number: int, reason: str) -> Iterator[Row]:
        """The writes, at most `most`, in the order of the flush; none is left."""
        place = {op: k for k, op in enumerate(FLUSH, 1)}
        rows = [(place.get(op, 0), v[1], op, entity, v[0], v[2]) for (op, entity, _), v in self.writes.iterator()]
        self.writes.clear()
        for at, seq, op, entity, payload, delta in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
            yield Row(project_id=key[0], part=key[1], flush=number, reason=reason, place=at, op=op, entity=entity, payload=payload, seq=seq, delta=delta)

    def close(self) -> None:
        pass


def flushes(writes: DataFrame, most: int = MOST, wait: int = WAIT, parts: int = 1) -> DataFrame:
    """project_id, part, flush, reason, place, op, entity, payload, seq, delta: a stream of pending writes in numbered flushes.

    writes(project_id, op, entity, payload, seq, delta) is a stream. A flush holds at most `most` different writes; what has waited
    for `wait` milliseconds is flushed by a timer, which lives in the checkpoint with the rest. A project of many writes is held
    in several parts, by entity. The state lies in RocksDB, which is set for the session if nothing else is.
    """
    spark = writes.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(setting, ""):
        spark.conf.set(setting, ROCKS)
    part = F.pmod(F.xxhash64("op", "entity"), F.lit(parts)).cast("int")
    return writes.select("project_id", part.alias("part"), "op", "entity", "payload", "seq", "delta").groupBy("project_id", "part").transformWithState(Pending(most, wait), OUT, "Append", "ProcessingTime")
