"""Decisions on suggestions as a stream with keyed state: each action changes its unit's state, and the changes are emitted.

The state of a unit (doc_id, unit_id): a map from suggestion to its sequence and decision, the id that is applied, the order of
the last action, and the timer of an old unit. Spark deals units to tasks by their key and keeps their state in RocksDB, whose
changes go to the stream's checkpoint, so a lost executor or a restart goes on from the last finished batch.

What stands after a log is review.replayed(); here the same comes as it happens.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

KEY = ["doc_id", "unit_id"]
CHANGE = "suggestion_id string, sequence long, at long, decision string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Decisions(StatefulProcessor):
    """Rows suggestion_id, at, action of a unit, in the order of `at` within a batch, become rows of CHANGE after the unit's key.

    decision is proposed, applied, dismissed or deleted; unknown_suggestion for an action before a propose or after a delete; late for
    one that is ordered before what an earlier batch has decided, and changes nothing; expired where an old unit is forgotten.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("suggestions", "suggestion_id string", "sequence long, decision string")
        self.applied = handle.getValueState("applied", "suggestion_id string")
        self.last = handle.getValueState("last", "at long")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable")
        past = self.last.get()[0] if self.last.exists() else None
        # what the batch asks of the state is read once and what it changes is written once, as each call goes to the store and back
        self.known: dict[str, tuple[int, str] | None] = {}
        self.now = before = self.applied.get()[0] if self.applied.exists() else None
        self.changed: set[str] = set()
        changes: list[tuple] = []
        for sid, at, action in zip(batch["suggestion_id"], batch["at"], batch["action"], strict=True):
            at = int(at)
            if past is not None and at <= past:
                changes.append((sid, None, at, "late"))
            else:
                changes += self._act(sid, at, action)
        for sid in sorted(self.changed):
            self.held.updateValue((sid,), self.known[sid])
        if self.now is None and before is not None:
            self.applied.clear()
        elif self.now != before:
            self.applied.update((self.now,))
        newest = int(batch["at"].max())
        if past is None or newest > past:
            self.last.update((newest,))
        if self.idle_ms is not None:
            self._wait(int(batch["ts"].max().timestamp() * 1000) + self.idle_ms)
        yield self._frame(key, changes)

    def _known(self, sid: str) -> tuple[int, str] | None:
        """(sequence, decision) of a suggestion, null for one that was never proposed."""
        if sid not in self.known:
            found = self.held.getValue((sid,)) if self.held.exists() and self.held.containsKey((sid,)) else None
            self.known[sid] = None if found is None else (int(found[0]), found[1])
        return self.known[sid]

    def _act(self, sid: str, at: int, action: str) -> list[tuple]:
        known = self._known(sid)
        if known is None and action == "propose":
            return [self._set(sid, at, at, "proposed")]
        if known is None or known[1] == "deleted":
            return [(sid, None, at, "unknown_suggestion")]
        if action == "propose":
            return []
        now, out = self.now, []
        if now is not None and (action == "apply" or now == sid):
            self.now = None
            if now != sid:
                out.append(self._set(now, self._known(now)[0], at, "dismissed"))
        if action == "apply":
            self.now = sid
        return [*out, self._set(sid, known[0], at, {"apply": "applied", "dismiss": "dismissed", "delete": "deleted"}[action])]

    def _set(self, sid: str, sequence: int, at: int, decision: str) -> tuple:
        self.known[sid] = (sequence, decision)
        self.changed.add(sid)
        return sid, sequence, at, decision

    def _wait(self, ms: int) -> None:
        if self.timer.exists():
            before = self.timer.get()[0]
            if before >= ms:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = int(self.last.get()[0]) if self.last.exists() else 0
        for state in (self.held, self.applied, self.last, self.timer):
            state.clear()
        yield self._frame(key, [(None, None, last, "expired")])

    def _frame(self, key, changes: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(changes, columns=["suggestion_id", "sequence", "at", "decision"]).astype({"sequence": "Int64", "at": "Int64"})
        frame.insert(0, "unit", key[0])
        return frame

    def close(self) -> None:
        pass


def changes(log: DataFrame, idle: str | None = None, late: str = "1 hour") -> DataFrame:
    """A streaming log (doc_id, unit_id, suggestion_id, at, action; ts too with idle) as the changes it makes, in append mode.

    Actions of one unit may come in any order within a batch, but a batch later only those ordered after it take effect. With
    idle ('30 days'), a unit whose last action is older than that, by the watermark on ts, is forgotten. All of a unit's
    actions in one batch are in one task's memory: bound a batch by maxFilesPerTrigger where a unit may have very many.
    Rows without at, suggestion or action are left out.
    """
    log = log.filter("at IS NOT NULL AND suggestion_id IS NOT NULL AND action IN ('propose', 'apply', 'dismiss', 'delete')")
    # one key without nulls: pandas takes a null key for another one at every row
    columns = [F.to_json(F.struct(*KEY)).alias("unit"), "suggestion_id", "at", "action"]
    rows = log.select(*columns) if idle is None else log.select(*columns, "ts").withWatermark("ts", late)
    ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    made = rows.groupBy("unit").transformWithStateInPandas(Decisions(ms), f"unit string, {CHANGE}", "Append", "None" if idle is None else "EventTime")
    key = F.from_json("unit", ", ".join(f"{c} {log.schema[c].dataType.simpleString()}" for c in KEY))
    return made.select(key.alias("key"), "*").select("key.*", "suggestion_id", "sequence", "at", "decision")


@contextmanager
def _rocks(spark: SparkSession):
    """Map state needs this store; the session's own setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def follow(log: DataFrame, path: str, **options) -> DataFrame:
    """Runs over what the log has now and adds the changes to path/changes; run again, it goes on from path/checkpoint."""
    spark = log.sparkSession
    made = changes(log, **options)
    with _rocks(spark):
        run = made.writeStream.format("parquet").option("path", f"{path}/changes").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/changes")


def standing(changed: DataFrame) -> DataFrame:
    """What stands after the changes, as review.replayed(): doc_id, unit_id, suggestion_id, sequence, decision."""
    key = [*KEY, "suggestion_id"]
    made = changed.filter("decision IN ('proposed', 'applied', 'dismissed', 'deleted')")
    # a suggestion that is dismissed by another's apply has that one's `at`; no two changes of one suggestion share it
    last = made.groupBy(*key).agg(F.max_by(F.struct("sequence", "decision"), "at").alias("last"))
    return last.select(*key, "last.sequence", "last.decision").filter("decision <> 'deleted'")


def dealt_by_order(log: DataFrame, parts: int) -> DataFrame:
    """log with part, from 0: its rows in the order of at, in about equal parts, by approximate quantiles."""
    cuts = log.approxQuantile("at", [k / parts for k in range(1, parts)], 0.01)
    return log.withColumn("part", sum((F.when(F.col("at") > c, 1).otherwise(0) for c in cuts), F.lit(0)))
